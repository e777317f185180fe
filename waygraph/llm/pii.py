"""Personal data: generators propose spans, boosted trees score them, thresholds decide.

The main path is DataFrame code only. Base kinds (email, ip, card, phone) are exact
patterns with checks. High-recall generators propose further spans, which may overlap;
their format and context features go through boosted trees that are written out as
CASE expressions, calibrated per corpus-independent hold-out, and spans over the
threshold of their kind are added. The trees are fitted on the driver on a bounded set
of rows generated by rule (``TRAIN_ROWS``): no table here labels personal data.

Edge cases: a null or empty text has no spans; a row without doc_id is a row like any
other; repeated rows give equal rows; proposals of equal probability are judged each by
itself; an empty table gives an empty result; other columns are ignored. Digit chains and mailbox names
are scanned once from their start, so that long runs cost linear time.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waygraph.llm.common import joined, matches, only

# A run of mailbox characters is tried from its start only (or where the last match
# ended): from any later place in it the match fails or succeeds alike.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# Whole chains of 16 to 19 digits; a chain is digits with single separators between them.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")

SSN = r"(?<![0-9-])[0-9]{3}[-\x20][0-9]{2}[-\x20][0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
LOCAL = r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
AMEX = r"(?<![0-9])(?<![0-9][\x20-])3[47](?:[\x20-]?[0-9]){13}(?![\x20-]?[0-9])"
MASKED = r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[\[(]\x20?dot\x20?[\])]|\.)\x20?[A-Za-z0-9-]{1,63}){1,4}"
ADDED = ("ssn", "iban", "local_phone", "amex", "masked_email")

FOR = r"(?i)ssn|social|tax|iban|account|bank|tel|phone|call|mobile|fax|card|amex|mail|contact|reach|write"
AGAINST = r"(?i)order|invoice|version|ref|page|isbn|article|serial|build|ticket|sku"
LEFT, RIGHT = 32, 16
TRAIN_ROWS = 6000
FEATURES = ("kind", "digits", "chars", "distinct", "seps", "says", "denies", "valid", "glued")


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    d = F.reverse(F.split(_digits(c), ""))
    total = F.aggregate(
        F.transform(d, lambda x, i: F.when(i % 2 == 1, F.when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)).otherwise(x.cast("int"))),
        F.lit(0),
        lambda a, x: a + F.coalesce(x, F.lit(0)),
    )
    return total % 10 == 0


def _mod97(c: Column) -> Column:
    bare = F.replace(c, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
    return F.aggregate(
        F.transform(F.split(turned, ""), lambda x: F.ascii(x)),
        F.lit(0),
        lambda a, x: F.when(x >= 65, (a * 100 + x - 55) % 97).otherwise((a * 10 + x - 48) % 97),
    )


def base_spans(text: Column) -> dict[str, Column]:
    """array<struct<start,end,body>> per base kind, failing matches dropped."""
    ip_ok = F.lit(rf"^{PART}\.{PART}\.{PART}\.{PART}$")
    digits = text.rlike(r"[0-9]")
    return {
        "email": matches(text, EMAIL, 0, text.contains("@")),
        "ip": F.filter(matches(text, IP, 0, digits & text.rlike(r"[0-9]\.[0-9]")), lambda m: F.regexp_like(m["body"], ip_ok)),
        "card": F.filter(matches(text, CARD, 0, digits & text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")), lambda m: luhn(m["body"])),
        "phone": F.filter(matches(text, PHONE, 0, text.contains("+")), lambda m: F.length(_digits(m["body"])).between(8, 15)),
    }


def candidate_spans(text: Column) -> dict[str, Column]:
    """Overlapping proposals of the high-recall generators."""
    grouped = text.rlike(r"[0-9]{3}[)\x20.-]")
    masked = F.lower(text).rlike(r"[\[(]\x20?at\x20?[\])]")
    return {
        "ssn": matches(text, SSN, 0, grouped),
        "iban": matches(text, IBAN),
        "local_phone": matches(text, LOCAL, 0, grouped),
        "amex": matches(text, AMEX, 0, text.rlike(r"3[47](?:[\x20-]?[0-9]){13}")),
        "masked_email": matches(text, MASKED, 0, masked),
    }


def features(text: Column, m: Column, kind: str) -> list[Column]:
    """Format and context of one candidate, as doubles in the order of FEATURES."""
    left = text.substr(F.greatest(m["start"] + 1 - LEFT, F.lit(1)), F.least(m["start"], F.lit(LEFT)))
    right = text.substr(m["end"] + 1, F.lit(RIGHT))
    body, digits = m["body"], _digits(m["body"])
    valid = {
        "ssn": ~body.rlike(r"^(?:000|666|9)") & ~body.rlike(r"0000$") & ~body.rlike(r"^...[- ]00"),
        "iban": _mod97(body) == 1,
        "local_phone": ~body.rlike(r"^\(?[01]"),
        "amex": luhn(body),
        "masked_email": body.rlike(r"(?i)(?:dot[\])]|\.)\x20?[a-z]{2,}$"),
    }[kind]
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return [
        F.lit(float(ADDED.index(kind))),
        number(F.length(digits)),
        number(F.length(body)),
        number(F.size(F.array_distinct(F.split(digits, "")))),
        number(F.length(F.regexp_replace(body, r"[A-Za-z0-9]", ""))),
        number(left.rlike(FOR)),
        number(left.rlike(AGAINST)),
        number(valid),
        number(left.rlike(r"[A-Za-z0-9_#/=]$") | right.rlike(r"^[A-Za-z0-9_/=]")),
    ]


# ---- fitting, on the driver, over a bounded set --------------------------------------


#: Length of an account number by country, as published for the format.
IBAN_DIGITS = {"DE": 18, "AT": 16, "PL": 24, "PT": 21, "DK": 14, "ES": 20, "SE": 20, "EE": 16}
#: Contexts of generated rows: said for it, said against it, neither.
TOLD = ("my ssn ", "social security no ", "tel. ", "phone: ", "call ", "bank account ", "IBAN ", "card ", "mail ", "contact ", "fax ", "write to ")
DENIED = ("order ", "invoice ", "version ", "ref ", "page ", "isbn ", "serial ", "build ", "ticket ")
PLAIN = ("", "the ", "of ", "and then ", "it was ", "see ", "with ", "nr ", "id ", "es ist ", "voici ", "que ", "(")


def training_set(spark: SparkSession, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Generated candidates in contexts, with labels; features by the same expressions.

    Right ones are made by the formats' own rules (check digits are computed), wrong ones
    break a rule or stand where a number means something else. Two in five contexts say
    nothing, and a tenth say the wrong thing.
    """
    r = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    pick = lambda salt, words: F.element_at(F.array(*[F.lit(w) for w in words]), r(salt, len(words)) + 1)
    digits = lambda salt, n: F.substring(F.concat(*[F.lpad(F.pmod(F.xxhash64("id", F.lit(f"{salt}{i}")), F.lit(10**9)).cast("string"), 9, "0") for i in range(-(-n // 9))]), 1, n)
    y = (r("y", 2) == 1).cast("int")
    told = F.when(r("noise", 10) == 0, 1 - y).otherwise(y)
    says = F.when(r("mute", 5) < 2, pick("p", PLAIN)).when(told == 1, pick("f", TOLD)).otherwise(pick("a", DENIED))
    sep = pick("sep", ("-", " ", "."))
    country = pick("i2", tuple(IBAN_DIGITS))
    account = lambda n: F.element_at(F.create_map(*[F.lit(x) for k in IBAN_DIGITS for x in (k, IBAN_DIGITS[k])]), n)
    number = F.substring(digits("i4", 27), F.lit(1), account(country))
    check = F.lpad((98 - _mod97(F.concat(country, F.lit("00"), number))).cast("string"), 2, "0")
    wrong = F.lpad(F.pmod(check.cast("int") + 1 + r("i3", 90), F.lit(97)).cast("string"), 2, "0")
    iban = F.concat(country, F.when(y == 1, check).otherwise(wrong), number)
    iban = F.when(r("i5", 2) == 0, F.trim(F.regexp_replace(iban, r"(.{4})", r"$1 "))).otherwise(iban)
    begun = F.concat(pick("m1", ("34", "37")), digits("m2", 12))
    ended = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(begun, d.cast("string")))
    amex = F.when(y == 1, F.element_at(F.filter(ended, luhn), 1)).otherwise(F.element_at(F.filter(ended, lambda x: ~luhn(x)), r("m3", 9) + 1))
    amex = F.when(r("m4", 2) == 0, F.regexp_replace(amex, r"^(.{4})(.{6})(.{5})$", r"$1 $2 $3")).otherwise(amex)
    part = lambda salt: pick(salt, ("an", "jo", "mi", "ka", "ro", "te", "li", "su", "ve", "do"))
    person = F.concat(part("e1"), part("e2"), pick("e3", ("", ".", "_", "7")), part("e4"))
    shapes = {
        "ssn": F.concat(F.when(y == 1, F.lpad((r("s1", 664) + 1).cast("string"), 3, "0")).otherwise(pick("s4", ("000", "666", "912", "955", "987"))), pick("s6", ("-", "-", " ")), F.lpad((r("s2", 98) + 1).cast("string"), 2, "0"), pick("s6", ("-", "-", " ")), F.lpad((r("s3", 9998) + 1).cast("string"), 4, "0")),
        "iban": iban,
        "local_phone": F.concat(F.when(y == 1, (r("l1", 800) + 200).cast("string")).otherwise(F.lpad(r("l2", 200).cast("string"), 3, "0")), sep, digits("l3", 3), sep, digits("l4", 4)),
        "amex": amex,
        "masked_email": F.concat(person, pick("e5", (" (at) ", " [at] ")), F.when(y == 1, F.concat(part("e6"), part("e7"))).otherwise(digits("e8", 2)), F.lit("."), F.when(y == 1, pick("e9", ("com", "org", "de", "net", "info"))).otherwise(digits("e0", 2))),
    }
    base = spark.range(0, rows, 1, 4).withColumn("k", F.pmod("id", F.lit(len(ADDED)))).withColumn("y", y).withColumn("says", says)
    out = []
    for i, kind in enumerate(ADDED):
        made = base.where(F.col("k") == i).select("y", F.concat("says", shapes[kind], pick("t", (" and so on", ".", ", then", "/a", "")) ).alias("text"))
        m = F.element_at(F.col("ms"), 1)
        found = made.withColumn("ms", candidate_spans(F.col("text"))[kind]).where(F.size("ms") > 0)
        out += found.select("y", F.array(*features(F.col("text"), m, kind)).alias("x")).collect()
    x = np.array([r["x"] for r in out])
    return x, np.array([r["y"] for r in out], dtype=float)


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, float]:
    """Best (gain, feature, threshold) for second-order boosting."""
    best = (1e-9, -1, 0.0)
    score = lambda a, b: a * a / (b + 1.0)
    whole = score(g.sum(), h.sum())
    for j in range(x.shape[1]):
        for t in np.unique(x[:, j])[:-1]:
            low = x[:, j] <= t
            gain = score(g[low].sum(), h[low].sum()) + score(g[~low].sum(), h[~low].sum()) - whole
            if gain > best[0]:
                best = (gain, j, float(t))
    return best


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    _, j, t = _split(x, g, h) if depth and len(x) > 20 else (0, -1, 0.0)
    if j < 0:
        return float(-g.sum() / (h.sum() + 1.0))
    low = x[:, j] <= t
    return (j, t, _grow(x[low], g[low], h[low], depth - 1), _grow(x[~low], g[~low], h[~low], depth - 1))


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    j, t, a, b = tree
    return np.where(x[:, j] <= t, _apply(a, x), _apply(b, x))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3, precision: float = 0.9) -> dict:
    """Boosted trees on two thirds; calibration and thresholds per kind on the rest."""
    held = np.arange(len(y)) % 3 == 0
    raw, trees = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw[~held]))
        trees.append(_grow(x[~held], p - y[~held], p * (1 - p), depth))
        raw += rate * _apply(trees[-1], x)
    a, b = 1.0, 0.0  # Platt scaling by Newton steps
    for _ in range(25):
        z = raw[held]
        p = 1 / (1 + np.exp(-(a * z + b)))
        w = p * (1 - p) + 1e-6
        grad = np.array([((p - y[held]) * z).sum(), (p - y[held]).sum()])
        hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, grad)
    p = 1 / (1 + np.exp(-(a * raw + b)))
    cut = {}
    for i, kind in enumerate(ADDED):
        own = held & (x[:, 0] == i)
        good = [t for t in np.arange(0.5, 0.96, 0.05) if (p[own] >= t).any() and y[own][p[own] >= t].mean() >= precision]
        cut[kind] = float(min(good, default=0.95))
    return {"trees": trees, "rate": rate, "a": float(a), "b": float(b), "cut": cut, "held_accuracy": float(((p > 0.5) == (y > 0.5))[held].mean())}


def _case(tree, x: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    j, t, a, b = tree
    return F.when(F.get(x, F.lit(j)) <= t, _case(a, x)).otherwise(_case(b, x))


def logit(p: float) -> float:
    return math.log(p / (1 - p))


def _accepted_kind(text: Column, spans: Column, kind: str, model: dict) -> Column:
    # calibrated probability >= cut, said of the raw sum
    need = (logit(model["cut"][kind]) - model["b"]) / model["a"]
    scored = F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.array(*features(text, m, kind)).alias("x")))
    total = lambda s: sum((_case(t, s["x"]) for t in model["trees"]), F.lit(0.0)) * model["rate"]
    return F.transform(F.filter(scored, lambda s: total(s) >= need), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def accepted(text: Column, model: dict) -> Column:
    """Candidates over their kind's threshold, as array<struct<kind,start,end>>."""
    out = []
    for kind, spans in candidate_spans(text).items():
        out.append(_accepted_kind(text, spans, kind, model))
    return F.concat(*out)


def scan(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """Per row doc_id, found (base spans) and added, each by kind as listed, then start."""
    model = model or fit(*training_set(docs.sparkSession))
    text = F.coalesce(F.col("text"), F.lit(""))
    said = lambda k: lambda m: F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))
    base = [F.transform(v, said(k)) for k, v in base_spans(text).items()]
    rows = only(docs, "doc_id", "text").select("doc_id", F.concat(*base).alias("found"), accepted(text, model).alias("added"))
    # a proposal inside what is found already adds nothing
    return rows.withColumn("added", F.filter("added", lambda a: ~F.exists("found", lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"]))))


def redact(text: Column, spans: Column, mark: str = "[PII]") -> Column:
    """``text`` with the union of ``spans`` replaced, overlapping ones once."""
    cut = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return F.aggregate(
        cut,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))),
    )


def op7_pii_boosting(spark, sf_dir: str) -> DataFrame:
    scanned = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.col("found")).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("found", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )
