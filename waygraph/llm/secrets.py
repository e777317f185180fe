"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Patterns propose candidates. A candidate's value is hashed; for each hash the corpus
gives the number of distinct repositories and owners. A value that many owners have is
a copied example; one that a few owners have and that looks random is live. Base kinds
(assign, access, hex) always stay; candidates of the other kinds stay where the counts
make them live.

Edge cases: a null or empty text has no spans; a row without doc_id gives a row like any
other; a null source counts as one owner of its
own; repeated rows give equal rows; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waygraph.llm.common import free, joined, matches, only, stored

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: A run of 20 or more from its start on is AKIA[A-Z0-9]+ of 20 or more characters, and so for hex.
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
#: Kinds that the method adds if the corpus shows that they are live.
VENDOR = r"(?:gh[pousr]_[A-Za-z0-9]{36,}+|xox[baprs]-[A-Za-z0-9-]{10,}+|[sr]k_live_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20,}+)"
JWT = r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
OPAQUE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}+"
BASE = ("assign", "access", "hex")
ADDED = ("vendor", "jwt", "opaque")
PLACEHOLDER = "(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|123456|abcdef|" + "|".join(f"{c}{{6}}" for c in "0123456789abcdefghijklmnopqrstuvwxyz")


def _kind(name: str, text: Column, pattern: str, keep, groups: int = 0, likely: Column | None = None) -> Column:
    found = F.filter(matches(text, pattern, groups, likely), keep) if keep else matches(text, pattern, groups, likely)
    return F.transform(
        found,
        lambda m: F.struct(F.lit(name).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["body"].alias("body")),
    )


def find(text: Column) -> dict[str, Column]:
    """Candidate spans of each kind in a text column (not null)."""
    small = F.lower(text)
    says = small.contains(ASSIGN_WORDS[0])
    for w in ASSIGN_WORDS[1:]:
        says = says | small.contains(w)
    mixed = lambda m: m["body"].rlike("[0-9]") & m["body"].rlike("[A-Z]") & m["body"].rlike("[a-z]")
    vendor = text.contains("_") | text.contains("xox") | text.contains("AIza") | text.contains("glpat")
    return {
        "assign": _kind("assign", text, ASSIGN, lambda m: F.length(m["body"]) >= 6, 1, says),
        "access": _kind("access", text, ACCESS, None, 0, text.contains("AKIA")),
        "hex": _kind("hex", text, HEX, None),
        "vendor": _kind("vendor", text, VENDOR, None, 0, vendor),
        "jwt": _kind("jwt", text, JWT, None, 0, text.contains("eyJ")),
        "opaque": _kind("opaque", text, OPAQUE, mixed),
    }


def _order(spans: Column, kinds: tuple[str, ...]) -> Column:
    """By start, then kind in the order of ``kinds``, then end."""
    place = F.array(*[F.lit(k) for k in kinds])
    keyed = F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), F.array_position(place, s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    return F.array_sort(F.array_distinct(keyed))


def live_looking(body: Column) -> Column:
    """Letters and digits, eight different characters, and nothing that marks an example."""
    return (
        body.rlike("[0-9]")
        & body.rlike("[A-Za-z]")
        & (F.size(F.array_distinct(F.split(body, ""))) >= 8)
        & ~body.rlike(PLACEHOLDER)
    )


def ownership(candidates: DataFrame) -> DataFrame:
    """Distinct owners and repositories of each hash, aggregated before each shuffle."""
    once = candidates.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = once.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def candidates(docs: DataFrame, whole: bool = False) -> DataFrame:
    """Per row of ``docs`` its spans of base kinds (found) and of added ones (more), stored; with ``whole``, the row itself too."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs if whole else only(docs, "doc_id", "text", "source", "lang")
    spans = find(text)
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole else []
    return stored(
        base.select(
            "doc_id",
            F.xxhash64(text).alias("tkey"),
            F.col("source").alias("owner"),
            F.concat_ws("/", "source", "lang").alias("repo"),
            F.concat(*[spans[k] for k in BASE]).alias("found"),
            F.concat(*[spans[k] for k in ADDED]).alias("more"),
            *row,
        ),
        "secrets",
    )


def scan(docs: DataFrame, max_owners: int = 2) -> DataFrame:
    """Per row of ``docs`` its spans, with each span's verdict.

    ``max_owners``: a value that more owners have is a copied example. Returns doc_id,
    tkey (hash of the text), found (base spans), verdicts (array of
    struct<start,end,kind,live,owners,repos>, base and added).
    """
    return judged(candidates(docs), max_owners)


def judged(rows: DataFrame, max_owners: int = 2) -> DataFrame:
    """``scan`` of rows whose candidates are known."""
    rows = rows.drop("row")
    # a candidate that overlaps a base span is that span's value, found again
    own = rows.withColumn(
        "more",
        F.filter("more", lambda m: ~F.exists("found", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))),
    )
    each = (
        own.select("doc_id", "tkey", "owner", "repo", F.explode(F.concat("found", "more")).alias("s"))
        .select("doc_id", "tkey", "owner", "repo", "s.kind", "s.start", "s.end", F.xxhash64("s.body").alias("hash"), live_looking(F.col("s.body")).alias("looks"))
    )
    named = each.join(ownership(each), "hash").select(
        "doc_id",
        "tkey",
        F.struct("start", "end", "kind", (F.col("looks") & (F.col("owners") <= max_owners)).alias("live"), "owners", "repos").alias("v"),
    )
    verdicts = named.groupBy("doc_id", "tkey").agg(F.collect_set("v").alias("verdicts"))
    none = F.expr("cast(array() as array<struct<start:int,end:int,kind:string,live:boolean,owners:bigint,repos:bigint>>)")
    # rows without candidates need no join
    named = verdicts.select(F.col("doc_id").alias("vdoc"), F.col("tkey").alias("vkey"), "verdicts")
    same = F.col("doc_id").eqNullSafe(F.col("vdoc")) & (F.col("tkey") == F.col("vkey"))
    hit = rows.where(F.size("found") + F.size("more") > 0).join(named, same)
    miss = rows.where(F.size("found") + F.size("more") == 0).withColumn("verdicts", none)
    out = hit.select(*miss.columns).unionByName(miss)
    return out.select("doc_id", "tkey", "found", "verdicts")


def kept(verdicts: Column) -> Column:
    """Base spans, and live ones of the added kinds."""
    return F.filter(verdicts, lambda v: v["live"] | v["kind"].isin(*BASE))


def digest(scanned: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(_order(F.col("found"), BASE)).cast("binary"), 256).alias("base_sha256"),
        joined(_order(kept(F.col("verdicts")), BASE + ADDED)).alias("spans"),
        F.size(F.filter("verdicts", lambda v: v["live"])).cast("long").alias("n_live"),
        F.size(F.filter("verdicts", lambda v: ~v["live"])).cast("long").alias("n_copied_or_dull"),
    )


def redact(docs: DataFrame, scanned: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with live spans replaced by ``mark``; n_chars follows. All rows stay."""
    doc, key, cuts, new = free(docs, "doc_", "key_", "cuts_", "new_")
    todo = scanned.select(
        F.col("doc_id").alias(doc),
        F.col("tkey").alias(key),
        F.array_sort(F.transform(F.filter("verdicts", lambda v: v["live"]), lambda v: F.struct(v["start"].alias("start"), v["end"].alias("end")))).alias(cuts),
    ).where(F.size(cuts) > 0).dropDuplicates([doc, key])
    text = F.col("text")
    cut = F.aggregate(
        cuts,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))),
    )
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(key))
    both = docs.join(todo, same, "left").withColumn(new, F.when(F.col(cuts).isNotNull(), cut).otherwise(text))
    fresh = {"text": F.col(new).alias("text"), "n_chars": F.when(F.col(cuts).isNotNull(), F.length(new).cast("long")).otherwise(F.col("n_chars")).alias("n_chars")}
    return both.select(*[fresh.get(c, F.col(f"`{c}`")) for c in docs.columns])


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``redact(docs, scan(docs))``, the texts of rows without candidates being neither dealt out nor sorted."""
    rows = candidates(docs, whole=True)
    some = F.size("found") + F.size("more") > 0
    cut = redact(rows.where(some).select("row.*"), judged(rows), mark)
    return cut.unionByName(rows.where(~some).select("row.*"))


def op4_secret_ownership(spark, sf_dir: str) -> DataFrame:
    return digest(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _found_sql(kind: str, pattern: str, group: int = 0, keep: str = "TRUE") -> str:
    pattern = pattern.replace("}+", "}").replace("'", "''")
    return f"""SELECT rid, '{kind}' AS kind, start, start + length(m) AS end_, body FROM (
      SELECT rid, ms[i] AS m, bodies[i] AS body, CAST(list_sum(gaps[1:i]) + coalesce(list_sum(lens[1:i - 1]), 0) AS BIGINT) AS start FROM (
        SELECT rid, ms, bodies, gaps, list_transform(ms, lambda x: length(x)) AS lens, unnest(range(1, len(ms) + 1)) AS i FROM (
          SELECT rid, regexp_extract_all(t, '{pattern}') AS ms, regexp_extract_all(t, '{pattern}', {group}) AS bodies, list_transform(regexp_split_to_array(t, '{pattern}'), lambda x: length(x)) AS gaps
          FROM d WHERE regexp_matches(t, '{pattern}')))) WHERE {keep}"""


def oracle(max_owners: int = 2) -> str:
    """The same as DuckDB SQL, whose patterns have no look-behind: opaque is cut from whole runs."""
    mixed = "regexp_matches(body, '[0-9]') AND regexp_matches(body, '[A-Z]') AND regexp_matches(body, '[a-z]')"
    kinds = ", ".join(f"'{k}'" for k in BASE + ADDED)
    joined_ = lambda src: f"(SELECT rid, string_agg(kind || ':' || start || ':' || end_, ',' ORDER BY start, list_position([{kinds}], kind), end_) AS j FROM (SELECT DISTINCT rid, kind, start, end_ FROM {src}) GROUP BY rid)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, chr(1)) AS owner, concat_ws('/', source, lang) AS repo FROM documents),
base AS ({_found_sql("assign", ASSIGN, 1, "length(body) >= 6")} UNION ALL {_found_sql("access", ACCESS)} UNION ALL {_found_sql("hex", HEX)}),
run AS (SELECT rid, start, string_split(body, '=')[1] AS body FROM ({_found_sql("run", "[A-Za-z0-9+/_=-]{24,}")})),
more AS ({_found_sql("vendor", VENDOR)} UNION ALL {_found_sql("jwt", JWT)}
  UNION ALL SELECT rid, 'opaque', start, start + length(body), body FROM run WHERE length(body) >= 24 AND {mixed}),
own AS (SELECT * FROM base UNION ALL SELECT * FROM more m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = m.rid AND b.start < m.end_ AND m.start < b.end_)),
freq AS (SELECT body, count(DISTINCT owner) AS owners FROM own JOIN d USING (rid) GROUP BY body),
verdict AS (SELECT DISTINCT rid, kind, start, end_, owners <= {max_owners} AND regexp_matches(body, '[0-9]') AND regexp_matches(body, '[A-Za-z]') AND len(list_distinct(string_split(body, ''))) >= 8
  AND NOT regexp_matches(body, '{PLACEHOLDER}') AS live FROM own JOIN freq USING (body)),
kept AS (SELECT * FROM verdict WHERE live OR kind IN ('assign', 'access', 'hex'))
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.j, '')) AS base_sha256, coalesce(k.j, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_dull, 0) AS n_copied_or_dull
FROM d LEFT JOIN (SELECT rid, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex FROM base GROUP BY rid) USING (rid)
LEFT JOIN (SELECT rid, count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_dull FROM verdict GROUP BY rid) USING (rid)
LEFT JOIN {joined_("base")} b USING (rid) LEFT JOIN {joined_("kept")} k USING (rid)
"""
