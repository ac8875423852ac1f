"""Personal data and the words that give it away.

Base finders: e-mail addresses, IPv4 addresses, card numbers with a valid check digit and international phone
numbers, each leftmost and non-overlapping within its kind. The information-theoretic part then asks how strongly
a term reveals a protected value: over the documents of the corpus, with n(t), n(e) and n(t, e) counted,

    disclosure(t, e) = PMI(t; e) / IC(e) = log(n(t, e) N / (n(t) n(e))) / log(N / n(e)),

which is 1 where the term stands in documents of that value only. Every term of every document that holds a value is
scored, and terms are removed from ``remove`` on and generalised from ``generalise`` on, wherever they stand, if they
meet the value more often than chance explains. A pair comes up because it met once, so its other meetings are tested:

    chance(t, e) = C(n(e) - 1, k) (n(t) - 1)_k / (N - 1)_k,  k = n(t, e) - 1,

bounds the probability of k or more further meetings, and must stay under ``chance`` for all pairs together. In the
test documents with equal words that hold a value on the same line count once. All of it is DataFrame operations.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, functions as F

from tessera.runtime import Scratch, broadcast_if_small

KINDS = ("email", "ip", "card", "phone")
#: Matches begin where the pattern's first run of characters begins, or where the last match ended: no shorter
#: start inside a run can match when the run's own start doesn't. Possessive repeats keep scans linear.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain before a kind's pattern is tried.
_FIRST = {"email": r"[A-Za-z0-9]@|[._%+-]@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": PATTERNS["card"], "phone": r"\+[0-9]"}
REMOVE, GENERALISE, CHANCE = 0.95, 0.8, 0.05
BROADCAST_BYTES = 32 << 20

_SPAN = "struct<kind: string, start: bigint, stop: bigint, value: string>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def _walk(text: Column, pattern: str, keeps: Callable[[Column], Column], kind: Callable[[Column], Column]) -> Column:
    """Spans of the matches that ``keeps`` keeps, in code points: what lies between matches gives their places.

    Matches are walked in about as many blocks as a block has matches, so that arrays grow by appending in blocks
    only: time goes with n times the root of n, not with its square.
    """

    def step(acc: Column, z: Column) -> Column:
        start = (acc["at"] + F.length(z["gap"])).cast("long")
        stop = (start + F.coalesce(F.length(z["hit"]), F.lit(0))).cast("long")
        span = F.struct(kind(z["hit"]).alias("kind"), start.alias("start"), stop.alias("stop"), z["hit"].alias("value"))
        return F.struct(stop.alias("at"), F.when(z["hit"].isNotNull() & keeps(z["hit"]), F.array_append(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    def walked(z: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(z))).cast("int")
        starts = F.sequence(F.lit(0), F.floor((F.size(z) - 1) / size).cast("int"))
        block = lambda k: F.aggregate(F.slice(z, k * size + 1, size), F.expr(f"struct(0L as at, cast(array() as array<{_SPAN}>) as found)"), step)
        return _let(F.transform(starts, block), joined)

    def joined(blocks: Column) -> Column:
        before = F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x["at"]))
        moved = lambda x, by: F.transform(x["found"], lambda s: F.struct(s["kind"].alias("kind"), (s["start"] + by).alias("start"), (s["stop"] + by).alias("stop"), s["value"].alias("value")))
        return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), moved))

    return _let(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")), walked)


def base_spans(text: Column, kind: str) -> Column:
    """The kind's spans in code points, end exclusive."""
    return F.when(F.regexp_like(text, F.lit(_FIRST[kind])), _walk(text, PATTERNS[kind], lambda m: _predicate(kind, m), lambda _: F.lit(kind))).otherwise(_NO_SPANS())


def _NO_SPANS() -> Column:
    return F.expr(f"cast(array() as array<{_SPAN}>)")


def _bare(part: Column) -> Column:
    return F.regexp_replace(part, "^0+", "")


def _predicate(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, "[.]"), lambda p: (F.length(_bare(p)) <= 3) & (F.coalesce(_bare(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "phone":
        return F.length(digits).between(8, 15)
    back = F.reverse(digits)
    doubled = F.translate(back, "0123456789", "0246813579")
    total = F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, F.substring(doubled, i, F.lit(1))).otherwise(F.substring(back, i, F.lit(1))).cast("int"))
    return F.when(F.length(digits).between(16, 19), total % 10 == 0).otherwise(F.lit(False))


def _terms(text: Column) -> Column:
    """Lower-cased maximal runs of letters and digits that hold a letter."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.regexp_like(t, F.lit(r"\p{L}")))


def _values(line: Column) -> Column:
    """For each base span of a line its value and a hash of what the line holds beside its kind's matches. No pattern crosses a line feed."""

    def of(kind: str) -> Column:
        hits = F.filter(F.regexp_extract_all(line, F.lit(PATTERNS[kind]), F.lit(0)), lambda m: _predicate(kind, m))
        value = (lambda m: F.regexp_replace(m, "[^0-9]", "")) if kind in ("card", "phone") else F.lower
        made = _let(F.xxhash64(F.split(line, PATTERNS[kind], -1)), lambda rest: F.transform(hits, lambda m: F.struct(F.concat(F.lit(kind + ":"), value(m)).alias("entity"), rest.alias("line"))))
        return F.when(F.regexp_like(line, F.lit(_FIRST[kind])), made).otherwise(F.expr("cast(array() as array<struct<entity: string, line: bigint>>)"))

    return F.concat(*[of(k) for k in KINDS])


def _blanked(text: Column) -> Column:
    """The text with blanks, as many as it has code points, in the place of each base span."""
    for kind in KINDS:
        text = _let(text, partial(_without, kind))
    return text


def _without(kind: str, text: Column) -> Column:
    blank = lambda gap, m: F.concat(gap, F.when(m.isNull(), "").when(_predicate(kind, m), F.repeat(F.lit(" "), F.length(m))).otherwise(m))
    joined = F.array_join(F.zip_with(F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), blank), "")
    return F.when(F.regexp_like(text, F.lit(_FIRST[kind])), joined).otherwise(text)


def _copy_keys(terms: Column) -> Column:
    """Four keys of three minima of hashes; near copies share one of them, other documents seldom do."""
    hashes = F.transform(terms, lambda t: F.xxhash64(t))
    salted = lambda k: lambda h: F.xxhash64(h, F.lit(k))
    lows = [F.array_min(F.transform(hashes, salted(k))) for k in range(12)]
    return F.array(*[F.xxhash64(F.lit(k), *lows[k : k + 3]) for k in range(0, 12, 3)])


def _log_factorial(x: Column) -> Column:
    """Stirling's series at x + 8, and back."""
    y, back = x + 8.0, F.lit(1.0)
    for k in range(1, 9):
        back = back * (x + float(k))
    return y * F.log(y) - y + 0.5 * F.log(y * (2 * math.pi)) + 1 / (12 * y) - 1 / (360 * y * y * y) - F.log(back)


def log_chance(n: Column, n_t: Column, n_e: Column, n_te: Column) -> Column:
    """Log of the bound on meeting n_te - 1 times more, after the meeting that brought the pair up."""
    k, a, b, n = n_te - 1, n_e - 1, n_t - 1, n - 1
    f = _log_factorial
    return f(a) + f(b) + f(n - k) - f(k) - f(a - k) - f(b - k) - f(n)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE, remove: float = REMOVE, chance: float = CHANCE) -> DataFrame:
    """doc_id, text, base and extra (arrays of kind, start, stop, value) for each row.

    A null text is empty and has no spans; a null id keeps its base spans and has no others; rows that repeat an
    id are all kept and counted as one document; other columns aren't used. Terms are sought beside base spans, which
    are blank to them. In ``extra`` the kind is term_removed or term_general.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    picked = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    some = lambda c: reduce(lambda a, b: a | b, [F.regexp_like(c, F.lit(_FIRST[k])) for k in KINDS])
    known = picked.where("doc_id is not null")
    lines = known.where(some(F.col("text"))).select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).where(some(F.col("line")))
    held = lines.select("doc_id", F.explode(_values(F.col("line"))).alias("v")).groupBy("v.entity", "doc_id").agg(F.min("v.line").alias("line"))
    held = scratch.write(held, "values")
    # a value of one document meets no term again
    held = scratch.write(held.join(held.groupBy("entity").agg(F.count("*").alias("n_e")).where("n_e > 1"), "entity"), "held")
    of = broadcast_if_small(held.select("doc_id").distinct(), BROADCAST_BYTES)
    terms = known.join(of, "doc_id", "left_semi").select("doc_id", F.array_distinct(_terms(_blanked(F.col("text")))).alias("terms"))
    terms = terms.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    terms = scratch.write(terms.select("doc_id", "terms", _copy_keys(F.col("terms")).alias("keys")), "terms")
    keys = held.select("entity", "doc_id", "line").join(terms.select("doc_id", "keys"), "doc_id").select("entity", "doc_id", "line", F.explode("keys").alias("key"))
    first = keys.groupBy("entity", "line", "key").agg(F.min("doc_id").alias("unit"))
    units = keys.join(first, ["entity", "line", "key"]).groupBy("entity", "doc_id").agg(F.min("unit").alias("unit"))
    held = scratch.write(held.join(units, ["entity", "doc_id"]).select("entity", "doc_id", "unit", "n_e"), "units")
    entities = held.groupBy("entity").agg(F.countDistinct("unit").alias("m_e"), F.first("n_e").alias("n_e")).where("m_e > 1")
    told_by = held.join(entities.select("entity"), "entity", "left_semi").join(terms.select("doc_id", "terms"), "doc_id")
    pairs = told_by.select("entity", "unit", F.explode("terms").alias("term")).groupBy("entity", "term", "unit").agg(F.count("*").alias("n")).groupBy("entity", "term").agg(F.count("*").alias("m_te"), F.sum("n").alias("n_te"))
    tested = scratch.write(pairs, "pairs")
    # two numbers
    tests, total = max(tested.join(entities, "entity", "left_semi").count(), 1), picked.select("doc_id").distinct().where("doc_id is not null").count()
    least, n = F.lit(math.log(chance / tests)), F.lit(float(total))
    # what no count of the term makes significant needs no count
    open_ = tested.join(entities, "entity").where((n > F.col("n_e")) & (log_chance(n, F.col("m_te"), F.col("m_e"), F.col("m_te")) <= least))
    open_ = scratch.write(open_, "open")
    scratch.drop("values", "held", "terms", "units", "pairs")
    wanted = broadcast_if_small(scratch.write(open_.select("term").distinct(), "wanted"), BROADCAST_BYTES)
    # rows that repeat an id are told from the others, whose terms are counted without their ids
    again = scratch.write(known.groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1"), "again")
    repeats = again.limit(1).count() > 0
    marked = known.join(broadcast_if_small(again, BROADCAST_BYTES), "doc_id", "left") if repeats else known.withColumn("times", F.lit(None).cast("long"))
    words = lambda few: marked.select("doc_id", "times", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("term")).join(few, "term")
    counts = words(wanted).where("times is null").groupBy("term").agg(F.count("*").alias("n_t"))
    if repeats:
        repeated = words(wanted).where("times is not null").select("doc_id", "term").distinct().groupBy("term").agg(F.count("*").alias("n_t"))
        counts = counts.union(repeated).groupBy("term").agg(F.sum("n_t").alias("n_t"))
    counts = scratch.write(counts, "counts")  # as a table, so that the rows of a frequent term can be split in the join
    score = F.log(F.col("n_te") * n / (F.col("n_t") * F.col("n_e"))) / F.log(n / F.col("n_e"))
    sure = log_chance(n, F.col("n_t") - F.col("n_te") + F.col("m_te"), F.col("m_e"), F.col("m_te")) <= least
    told = open_.join(broadcast_if_small(counts, BROADCAST_BYTES), "term").where(sure).groupBy("term").agg(F.max(score).alias("disclosure")).where(F.col("disclosure") >= generalise)
    told = scratch.write(told, "told")
    by_doc = words(broadcast_if_small(told, BROADCAST_BYTES)).groupBy("doc_id").agg(F.map_from_entries(F.collect_set(F.struct("term", F.when(F.col("disclosure") >= remove, "term_removed").otherwise("term_general")))).alias("told"))
    by_doc = broadcast_if_small(scratch.write(by_doc.withColumnRenamed("doc_id", "_told"), "by_doc"), BROADCAST_BYTES)

    base = F.concat(*[base_spans(F.col("text"), k) for k in KINDS])
    joined = picked.join(by_doc, F.col("doc_id") == F.col("_told"), "left")
    return joined.select("doc_id", "text", base.alias("base"), F.when(F.col("told").isNotNull(), _extra()).otherwise(_NO_SPANS()).alias("extra"))


def _extra() -> Column:
    """Spans of the document's telling terms, outside its base spans."""
    told = F.col("told")
    held = lambda m: F.coalesce(F.map_contains_key(told, F.lower(m)), F.lit(False))
    walked = _walk(_blanked(F.col("text")), r"[\p{L}\p{N}]+", held, lambda m: F.try_element_at(told, F.lower(m)))
    return _let(walked, lambda spans: F.concat(F.filter(spans, lambda s: s["kind"] == "term_removed"), F.filter(spans, lambda s: s["kind"] == "term_general")))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def sanitise(found: DataFrame) -> DataFrame:
    """doc_id and clean_text of a result of find(): base values and general terms give way to their kind in brackets, removed terms to nothing."""
    both = F.array_sort(F.concat("base", "extra"), lambda a, b: (a["start"] - b["start"]).cast("int"))
    built = F.aggregate(
        both,
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["stop"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.when(s["kind"] == "term_removed", "").when(s["kind"] == "term_general", "[TERM]").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length(F.col("text")))),
    )
    return found.select("doc_id", built.alias("clean_text"))


def digest(found: DataFrame) -> DataFrame:
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.array_remove(F.array_append(kinds, "none"), k)).cast("long") for k in KINDS]
    counts = [(F.size(kinds) + 1 - c).cast("long").alias(f"n_{k}") for k, c in zip(KINDS, counts, strict=True)]
    every = F.size("base").cast("long")
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "extra")).alias("spans"), F.size("extra").cast("long").alias("n_terms"), every.alias("n_base"), (every > 0).alias("has_pii"))
