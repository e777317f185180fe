"""BPE by automaton: merge gadgets decide the arcs, a table over bytes runs the words.

Merges are compiled in rank order. After the merge (x, y) has been added, its gadget
takes away each arc that would leave x and y side by side; so an arc t -> u between tokens
stands if no merge joins a right part of t with a left part of u while both parts exist.
A token whose own two halves are kept apart by an earlier gadget is never reached. There
is one path of standing arcs over a word, and its labels are the word's tokens.

That automaton reads tokens. It is made deterministic over bytes by the subset
construction: a state is the set of (last token, place in the trie of tokens) that what
was read so far allows. Each prefix of a word has one path too, so a state has one last
token, which says where the path's last arc began. A word is run by one table look-up a
byte; its path is then read off the states from its end. There is no search and no way
back. The whole table would have a row for every prefix of every word, so rows are entered
when a word first needs them, and at most ``MAX_STATES`` are held at a time.

Edge cases: a null text is empty and has no tokens; empty and repeated rows are rows like
any other; an empty table gives an empty result; other columns are ignored; a word of any
length is run in time linear in its length.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from waygraph.llm.common import only

#: The pre-split of byte-level BPE (fixed by the vocabulary's public format).
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same over characters for which the classes can be spelled out; faster.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_PLAIN = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_ASCII = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
_ODD = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")
MAX_WORDS, MAX_ARCS, MAX_STATES, LONG_WORD = 300_000, 300_000, 100_000, 64
NEVER = 1 << 60


def byte_symbols() -> dict[str, int]:
    """The format's printable stand-in for each byte: itself if printable, else 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in out.values():
            out[chr(256 + extra)] = b
            extra += 1
    return out


def read_model(path: str) -> dict:
    """Merges, ids and special tokens of a byte-level BPE file in the tokenizers format."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model, pre = data["model"], data["pre_tokenizer"]
    if model["type"] != "BPE" or model.get("ignore_merges") or data["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
        raise ValueError("not a plain byte-level BPE")
    sym = byte_symbols()
    raw = lambda s: bytes(sym[c] for c in s)
    merges = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    return {
        "ids": {raw(t): i for t, i in model["vocab"].items()},
        "merges": merges,
        "special": {t["content"]: t["id"] for t in data["added_tokens"]},
    }


class Automaton:
    """The merges' arcs between tokens, and the table over bytes that they give."""

    def __init__(self, model: dict):
        ids = model["ids"]
        self.special = model["special"]
        self.label: dict[int, bytes] = {i: t for t, i in ids.items()}
        self.label.update({i: s.encode() for s, i in self.special.items()})
        self._rank: dict[tuple[int, int], int] = {}
        self._born: dict[int, int] = {ids[bytes([b])]: -1 for b in range(256) if bytes([b]) in ids}
        self._halves: dict[int, tuple[int, int]] = {}
        self.token: dict[bytes, int] = {self.label[i]: i for i in self._born}
        for rank, (x, y) in enumerate(model["merges"]):
            self._gadget(rank, ids.get(x), ids.get(y), ids[x + y])
        self._arcs: dict[int, bool] = {}
        self._words: dict[str, bytes] = {}
        # trie of the tokens that can be reached: place << 8 | byte -> place; by place: the token that ends there, has it longer ones
        self._next: dict[int, int] = {}
        self._token, self._more = [-1], bytearray(1)
        for t, i in self.token.items():
            place = 0
            for b in t:
                self._more[place] = 1
                key = place << 8 | b
                if key not in self._next:
                    self._next[key] = len(self._token)
                    self._token.append(-1)
                    self._more.append(0)
                place = self._next[key]
            self._token[place] = i
        self._clear()
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _clear(self) -> None:
        """An empty table; state 0: nothing is read. Plain numbers, which cost the garbage collector nothing."""
        self._table: dict[int, int] = {}  # state << 8 | byte -> state
        self._state: dict[tuple[int, ...], int] = {}
        self._sets: list[tuple[int, ...]] = [(-1, 0)]  # last token, place, last token, place, ...
        self._last: list[int] = [-1]

    def _gadget(self, rank: int, x: int, y: int, joined: int) -> None:
        """Add one merge: the arc x -> y goes, and ``joined`` comes if that arc stood."""
        if x not in self._born or y not in self._born:
            return
        stood = not self._apart(x, y, rank)
        self._rank.setdefault((x, y), rank)
        if stood and joined not in self._born:
            self._born[joined] = rank
            self._halves[joined] = (x, y)
            self.token[self.label[joined]] = joined

    def _parts(self, t: int, side: int) -> list[tuple[int, int]]:
        """Parts of ``t`` at one edge, each with the rank of the merge that ends it."""
        out, end = [(t, NEVER)], NEVER
        while t in self._halves:
            end = self._born[t]
            t = self._halves[t][side]
            out.append((t, end))
        return out

    def _apart(self, t: int, u: int, before: int = NEVER) -> bool:
        """Has a gadget of a rank under ``before`` taken the arc t -> u away?

        At equal ranks the left merge goes first: the left part is taken by its own
        merge, while the right part is still there for this one.
        """
        rank = self._rank
        right = self._parts(u, 0)
        for a, a_end in self._parts(t, 1):
            for b, b_end in right:
                r = rank.get((a, b))
                if r is not None and r < before and r < a_end and r <= b_end:
                    return True
        return False

    def arc(self, t: int, u: int) -> bool:
        key = t << 20 | u
        if (stands := self._arcs.get(key)) is None:
            if len(self._arcs) >= MAX_ARCS:
                self._arcs.clear()
            stands = self._arcs[key] = not self._apart(t, u)
        return stands

    def _enter(self, state: int, byte: int) -> int:
        """The table's entry for a state and byte: each place moves on, and a token that ends begins a new one."""
        live, last, arcs, on, token, more = [], -1, self._arcs, self._next, self._token, self._more
        places = iter(self._sets[state])
        for t, place in zip(places, places, strict=True):
            place = on.get(place << 8 | byte)
            if place is None:
                continue
            u = token[place]
            if u >= 0 and last < 0:
                stands = t < 0 or arcs.get(t << 20 | u)
                if stands is None:
                    stands = self.arc(t, u)
                if stands:
                    last = u
            if more[place]:
                live += (t, place)
        if last < 0:
            raise ValueError("no path: the vocabulary lacks a byte")
        live += (last, 0)
        name = tuple(live)
        to = self._state.get(name)
        full = to is None and len(self._sets) >= MAX_STATES
        if full:  # a new table, which begins with this state
            self._clear()
        if to is None:
            to = self._state[name] = len(self._sets)
            self._sets.append(name)
            self._last.append(last)
        if not full:
            self._table[state << 8 | byte] = to
        return to

    def run(self, word: bytes) -> list[int]:
        """Labels of the one path over ``word``."""
        state, last = 0, array("i")  # the last token of each prefix
        for byte in word:
            to = self._table.get(state << 8 | byte)
            state = self._enter(state, byte) if to is None else to
            last.append(self._last[state])
        path, at, label = [], len(word), self.label
        while at:
            t = last[at - 1]
            path.append(t)
            at -= len(label[t])
        path.reverse()
        return path

    def word(self, w: str) -> bytes:
        """Packed ids of a pre-split word, kept for short words."""
        got = self._words.get(w)
        if got is None:
            got = array("I", self.run(w.encode("utf-8", "surrogatepass"))).tobytes()
            if len(w) <= LONG_WORD:
                if len(self._words) >= MAX_WORDS:
                    self._words.clear()
                self._words[w] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, word, out = self._words, self.word, []
        for piece in self._cut.split(text) if self._cut else [text]:
            if piece in self.special:
                out.append(array("I", [self.special[piece]]).tobytes())
                continue
            if piece.isascii() and not _ODD.search(piece):
                words = _ASCII.findall(piece)
            else:
                words = (SPLIT if _ODD.search(piece) else _PLAIN).findall(piece)
            for w in words:
                got = known.get(w)
                out.append(word(w) if got is None else got)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """Labels of the ids' arcs, as UTF-8 (bytes that are none become U+FFFD)."""
        label = self.label
        raw = b"".join([label[i] for i in array("I", ids)])
        return raw.decode("utf-8", "replace").encode()


_built: dict[int, Automaton] = {}


def _automaton(shared) -> Automaton:
    """One automaton for each worker process and model."""
    key = shared.id if hasattr(shared, "id") else id(shared)
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(shared.value)
    return _built[key]


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_rows(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text, one row for each of ``docs``.

    ``path`` is read on the driver; the model (its size is the vocabulary's) goes to the
    workers as a broadcast variable. ``with_ids`` adds ids, an array of int.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_model(path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(shared)
        for batch in batches:
            count, one, two, lists = [], [], [], []
            for text in batch.column("text"):
                ids = auto.encode(text.as_py() or "")
                count.append(len(ids) // 4)
                one.append(hashlib.sha256(ids).hexdigest())
                two.append(hashlib.sha256(auto.decode(ids)).hexdigest())
                if with_ids:
                    lists.append(array("I", ids).tolist())
            cols = [batch.column("doc_id").cast(pa.int64()), pa.array(count, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return only(docs, "doc_id", "text").mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_bpe_automaton(spark, sf_dir: str) -> DataFrame:
    return encode_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
