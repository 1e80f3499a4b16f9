"""Secret scans: fixed patterns plus a character Markov model.

Base kinds are regular expressions; the positions of their matches come from the
pieces between matches (``split``) and the matches (``regexp_extract_all``).  The
method adds kind ``markov``: long tokens whose bigram log-likelihood under a
model of random strings exceeds that under a model of ordinary identifiers.  The
models are trained from samples that the base patterns label: the matched values
are random strings, other tokens are ordinary.  A model span that meets a base
span is left out.  Only DataFrame functions are used.

Defined results: a null text is empty and has no spans; the sha256 of no spans is
that of the empty text; repeated rows are scanned each; positions are code
points, end exclusive, over the whole text; an empty table gives an empty table.
Without training samples the model adds nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroseries.llm.common import text_or_empty

# The patterns of the base kinds, in the order in which ties are listed.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of 20+ characters; a shorter run holds no longer one
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
# Tokens that the model looks at, and its alphabet.
TOKEN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
WORD = r"[A-Za-z0-9+/_=-]{4,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
OTHER = len(ALPHABET)
SYMBOL = [OTHER if (c := chr(i)) not in ALPHABET else ALPHABET.index(c) for i in range(128)]


SPANS = "array<struct<start:int,end:int,value:string>>"


def _walk(found, pieces):
    """Positions of the matches: running lengths of pieces and matches, in code points."""
    empty = F.array().cast(SPANS)

    def step(acc, i):
        m = F.element_at(found, i)
        start = acc["pos"] + F.length(F.element_at(pieces, i))
        end = start + F.length(m)
        return F.struct(end.alias("pos"),
                        F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), m.alias("value")))).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), empty.alias("out"))
    return F.when(F.size(found) > 0, F.aggregate(F.sequence(F.lit(1), F.size(found)), start, step)["out"]).otherwise(empty)


def with_matches(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Adds per name the spans of the leftmost non-overlapping matches.  The
    arrays are columns of their own first, so each pattern runs twice per text,
    however many matches there are."""
    text = text_or_empty()
    cols = docs.columns
    raw = docs.select("*", *[F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"_found_{n}") for n, p in patterns.items()],
                      *[F.split(text, p, -1).alias(f"_pieces_{n}") for n, p in patterns.items()])
    return raw.select(*cols, *[_walk(F.col(f"_found_{n}"), F.col(f"_pieces_{n}")).alias(n) for n in patterns])


def _long_assign(spans):
    return F.filter(spans, lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= 6)


def base_spans(docs: DataFrame) -> DataFrame:
    """The columns of docs and ``assign``, ``access``, ``hex``: arrays of spans."""
    d = with_matches(docs, {"assign": ASSIGN, "access": ACCESS, "hex": HEX})
    return d.withColumn("assign", _long_assign("assign"))


def _symbols(token):
    """array<int>: alphabet positions of a token's characters."""
    table = F.lit(SYMBOL)
    return F.transform(F.split(token, ""), lambda c: F.element_at(table, F.least(F.ascii(c), F.lit(127)) + 1))


def _bigram_counts(tokens: DataFrame) -> dict[int, int]:
    """Counts of (symbol, next symbol); at most (alphabet + 1)^2 rows come back.  Equal tokens are counted first."""
    k = OTHER + 1
    s = tokens.groupBy("token").agg(F.count("*").alias("n")).select(_symbols(F.col("token")).alias("s"), "n")
    code = F.transform(F.sequence(F.lit(2), F.size("s")), lambda i: F.element_at(F.col("s"), i - 1) * k + F.element_at(F.col("s"), i))
    got = s.where(F.size("s") >= 2).select(F.explode(code).alias("c"), "n").groupBy("c").agg(F.sum("n").alias("n"))
    return {int(r["c"]): int(r["n"]) for r in got.collect()}


def train(docs: DataFrame, max_docs: int = 4000) -> list[float] | None:
    """Log-likelihood ratio (random over ordinary) of each bigram, as a flat table.

    Ordinary tokens are those of all documents, without their base matches.  The sample of random
    strings, which the base patterns label, is bounded: it comes from the ``max_docs``
    documents of the smallest hash of doc_id among those with a base match."""
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    hit = F.regexp_extract("text", f"{ASSIGN}|{ACCESS}|{HEX}", 0) != ""
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    # ids first (bounded by max_docs), then their texts
    hits = texts.where(hit).select("doc_id").distinct().orderBy(*by_hash).limit(max_docs)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    plain = F.when(hit, plain).otherwise(F.col("text"))
    ordinary = texts.select(F.explode(F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))).alias("token"))
    values = F.concat(F.transform("assign", lambda m: F.regexp_extract(m["value"], ASSIGN, 2)),
                      F.transform("access", lambda m: m["value"]), F.transform("hex", lambda m: m["value"]))
    random = base_spans(texts.join(F.broadcast(hits), "doc_id", "left_semi")).select(F.explode(values).alias("token"))
    a, b = _bigram_counts(random), _bigram_counts(ordinary)
    if not a or not b:
        return None
    k = OTHER + 1

    def model(counts):
        # each row is smoothed towards the single characters, these towards the uniform distribution
        rows = [sum(counts.get(i * k + j, 0) for j in range(k)) for i in range(k)]
        ends = [sum(counts.get(i * k + j, 0) for i in range(k)) for j in range(k)]
        single = [(e + 0.5) / (sum(ends) + 0.5 * k) for e in ends]
        return [math.log((counts.get(i * k + j, 0) + 8 * single[j]) / (rows[i] + 8)) for i in range(k) for j in range(k)]

    return [round(x - y, 4) for x, y in zip(model(a), model(b))]


def llr(token, table: list[float]):
    """Log-likelihood ratio per bigram of a token."""
    k = OTHER + 1
    t = F.lit(table)
    s = F.aggregate(_symbols(token), F.struct(F.lit(-1).alias("p"), F.lit(0.0).alias("sum")),
                    lambda acc, c: F.struct(c.alias("p"), (acc["sum"] + F.when(acc["p"] < 0, F.lit(0.0)).otherwise(
                        F.element_at(t, acc["p"] * k + c + 1))).alias("sum")))["sum"]
    return s / F.greatest(F.length(token) - 1, F.lit(1))


def scan(docs: DataFrame, table: list[float] | None, threshold: float = 1.0) -> DataFrame:
    """The columns of docs and ``found``: array<struct<start, kind, end>> of all
    spans by start, then kind as listed (the position in KINDS)."""
    d = docs.drop(*({"assign", "access", "hex", "markov", "found"} & set(docs.columns)))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX} | ({} if table is None else {"markov": TOKEN})
    d = with_matches(d, patterns).withColumn("assign", _long_assign("assign"))
    if table is None:
        d = d.withColumn("markov", F.array().cast(SPANS))
    else:
        # random strings mix classes of characters; a token of letters in one case is a word
        def mixed(m):
            v = m["value"]
            return (v.rlike("[0-9]") & v.rlike("[A-Za-z]")) | v.rlike("[a-z][A-Z]")

        def fresh(m):
            met = lambda x: (x["start"] < m["end"]) & (m["start"] < x["end"])
            return ~(F.exists("assign", met) | F.exists("access", met) | F.exists("hex", met))

        d = d.withColumn("markov", F.filter("markov", lambda m: mixed(m) & fresh(m)))
        d = d.withColumn("markov", F.filter("markov", lambda m: llr(m["value"], table) >= F.lit(threshold)))

    def of(kind):
        return F.transform(KINDS[kind], lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    return d.withColumn("found", F.array_sort(F.concat(*[of(k) for k in range(len(KINDS))])))


def spans_text(found, kinds=len(KINDS)):
    """kind:start:end, comma-joined, of the first ``kinds`` kinds."""
    names = F.lit(list(KINDS))
    chosen = F.filter(found, lambda m: m["kind"] < kinds)
    return F.array_join(F.transform(chosen, lambda m: F.concat_ws(":", F.element_at(names, m["kind"] + 1), m["start"].cast("string"),
                                                                 m["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    return scanned.select("doc_id", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"),
                          F.size("hex").cast("long").alias("n_hex"), F.sha2(spans_text(F.col("found"), 3), 256).alias("base_sha256"),
                          spans_text(F.col("found")).alias("spans"), F.size("markov").cast("long").alias("n_markov"))


def redact(scanned: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Replace every span (overlapping ones as one) in ``text`` by ``mark`` and
    set ``n_chars`` where it exists; texts without spans stay as they are."""
    def step(acc, m):
        fresh = m["start"] >= acc["pos"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(F.col("text"), acc["pos"] + 1, m["start"] - acc["pos"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], m["end"]).alias("pos"), out.alias("out"))

    w = F.aggregate("found", F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step)
    clean = F.concat(w["out"], F.substring(F.col("text"), w["pos"] + 1, F.length("text")))
    d = scanned.withColumn("text", F.when(F.size("found") > 0, clean).otherwise(F.col("text")))
    if "n_chars" in d.columns:
        d = d.withColumn("n_chars", F.when(F.size("found") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return d.drop("assign", "access", "hex", "markov", "found")
