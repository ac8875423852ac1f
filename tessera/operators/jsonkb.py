"""Exact values from nested JSON: flattening that keeps literals, rules as columns, guarded filters, choices.

Leaves have entity, ord (document order), path (array of strings) and value (the literal, unchanged).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.runtime import broadcast_if_small

#: A task joins and sorts some so many leaves, however many there are.
LEAVES_A_TASK = 200_000
#: Up to so many partitions Spark's tasks write a shuffle without holding rows (its spark.shuffle.sort.bypassMergeThreshold).
UNHELD = 200
#: Tables of names are broadcast up to so many bytes of rows.
NAMES_BYTES = 8 << 20
SKIPPED = "_comment"
YEAR = r"^(19|20)\d{2}$"
NUMBER = r"^\s*\.?[0-9][0-9,]*(\.[0-9]*)?\s*$|^\s*-[0-9.]+\s*$"
#: Words that carry no meaning in a question, and what tells of the league's own tables.
STOP_WORDS = ["the", "a", "an", "of", "in", "for", "is", "was", "what", "how", "many", "did", "do", "does", "are", "were", "has", "have", "had", "with", "and", "to", "by", "at", "on", "s", "their", "his", "her", "number"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
STANDINGS = ["games back", "wild card", "elimination", "standings", "streak", "winning percentage", "division rank", "last 10"]


def flatten_document(raw: str):
    """(ord, path, literal) depth first. Numbers keep their text, booleans are True and False, nulls and comments are skipped."""
    if not raw:
        return
    stack, n = [((), json.loads(raw, parse_float=str, parse_int=str, parse_constant=str))], 0
    while stack:
        path, node = stack.pop()
        if isinstance(node, dict):
            stack += [((*path, k), v) for k, v in reversed(node.items()) if k != SKIPPED]
        elif isinstance(node, list):
            stack += [((*path, str(i)), v) for i, v in reversed(list(enumerate(node)))]
        elif node is not None:
            yield n, list(path), str(node)
            n += 1


def _flattened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(e, n, path, value) for e, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for n, path, value in flatten_document(raw)]
        if rows:
            kinds = [batch.schema.field(0).type, pa.int32(), pa.list_(pa.string()), pa.string()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["entity", "ord", "path", "value"])


def flatten(docs: DataFrame) -> DataFrame:
    """docs: entity, raw. A row for each leaf."""
    return docs.select("entity", "raw").mapInArrow(_flattened, f"entity {docs.schema['entity'].dataType.simpleString()}, ord int, path array<string>, value string")


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def tokens(question: Column) -> Column:
    return F.filter(F.split(F.lower(question), r"[^a-z0-9_\-]+"), lambda t: (t != "") & ~t.isin(STOP_WORDS))


def expand_synonyms(words: Column, synonyms: dict[str, list[str]]) -> Column:
    """Words and their synonyms, distinct."""
    if not synonyms:
        return F.array_distinct(words)
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]))])
    return F.array_distinct(F.concat(words, F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), F.expr("cast(array() as array<string>)"))))))


def base_score(path: Column, words: Column, raw: Column, strict: bool = False) -> Column:
    """Deeper segments weigh more; exact words 2, parts of words 0.8; years and months in both must agree.

    With ``strict`` a path without the year, or the month, that is asked for loses too.
    """
    n = F.size(path)

    def segment(p: Column, i: Column) -> Column:
        weight = 1 + i / F.greatest(n - 1, F.lit(1))
        pieces = F.filter(F.split(F.lower(p), r"[_\s]+"), lambda t: t != "")
        gain = lambda t: F.when(F.array_contains(words, t), 2.0).when((F.length(t) > 3) & F.exists(raw, lambda q: F.contains(q, t) | F.contains(t, q)), 0.8).otherwise(0.0)
        return weight * F.aggregate(F.transform(pieces, gain), F.lit(0.0), lambda s, x: s + x)

    total = F.aggregate(F.transform(path, segment), F.lit(0.0), lambda s, x: s + x)
    years = lambda a: F.filter(a, lambda t: F.regexp_like(t, F.lit(YEAR)))
    asked, held = years(raw), years(path)
    year = F.when(F.size(asked) == 0, 0.0).when(F.size(held) == 0, -4.0 if strict else 0.0).when(F.arrays_overlap(asked, held), 6.0).otherwise(-6.0)
    months, parts = F.array(*[F.lit(m) for m in MONTHS]), F.transform(path, lambda p: F.lower(p))
    wanted = F.array_intersect(raw, months)
    astray = F.arrays_overlap(parts, months) | F.array_contains(parts, "month")
    month = F.when(F.size(wanted) == 0, 0.0).when(F.arrays_overlap(parts, wanted), 6.0).when(astray | F.lit(strict), -6.0).otherwise(0.0)
    return total + year + month


def _tasks(leaves: int) -> int:
    """Stated numbers of partitions stay; those that Spark chooses are merged by their compressed bytes, which for leaves are few."""
    return -(-leaves // LEAVES_A_TASK) or 1


def spread(df: DataFrame, n: int, key: str = "entity") -> DataFrame:
    """df in n partitions by a column.

    With over ``UNHELD`` partitions a task holds and sorts what it writes. The first of two steps then takes the rows out of
    their files, which may be read by one task each, so that a task of the second holds but one in ``UNHELD`` of all rows.
    """
    if n > UNHELD:  # under another name between: adjacent repartitions become one
        df = df.withColumnRenamed(key, "_of").repartition(UNHELD, "_of").withColumnRenamed("_of", key)
    return df.repartition(n, key)


def dealt(entities: DataFrame, leaves_each: int) -> tuple[DataFrame, int]:
    """Entities in as many partitions as their leaves need, and that number, for ``tasks`` of what joins the leaves.

    Leaves and questions that are made of them stay where they are. Made of whole files, they would be dealt in their
    stead, and are many times as many.
    """
    n = _tasks(entities.count() * leaves_each)
    return spread(entities, n) if n > 1 else entities, n


def score(leaves: DataFrame, questions: DataFrame, rules: list[tuple[Column, float]] | None = None, synonyms: dict | None = None, strict: bool = False, tasks: int | None = None) -> DataFrame:
    """Every leaf of a question's entity with its score; rules are (predicate, bonus) columns that add up.

    questions: qid, entity, question. tasks: that of ``dealt`` entities, else leaves are counted.
    """
    raw = tokens(F.col("question"))
    q = questions.select("qid", "entity", "question", raw.alias("raw"), expand_synonyms(raw, synonyms or {}).alias("words"))
    n = tasks or _tasks(leaves.count())
    if not tasks:
        leaves, q = spread(leaves, n), spread(q, n)
    j = leaves.repartition(n, "entity").join(q.repartition(n, "entity").hint("merge"), "entity")
    total = base_score(F.col("path"), F.col("words"), F.col("raw"), strict)
    for predicate, bonus in rules or []:
        total = total + F.when(predicate, F.lit(float(bonus))).otherwise(0.0)
    return j.withColumn("score", total).repartition(n, "qid")  # what follows is by question


def guarded(scored: DataFrame, wrong: Column) -> DataFrame:
    """Drop a leaf that is wrong only if the same leaf name is there, for the same question, and isn't."""
    w = Window.partitionBy("qid", F.element_at("path", -1))
    ok = F.max((~wrong).cast("int")).over(w)
    return scored.withColumn("_ok", ok).where(~wrong | (F.col("_ok") == 0)).drop("_ok")


def top_leaves(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 6)), "ord")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def asked(questions: DataFrame, best: DataFrame, tasks: int = 1) -> DataFrame:
    """Every qid with what is best for it, if anything. tasks: the number of partitions that best is in."""
    q = questions.select("qid")
    return (spread(q, tasks, "qid") if tasks > UNHELD else q).join(best, "qid", "left")


def answers(scored: DataFrame, questions: DataFrame, nothing: str = "no answer", tasks: int = 1) -> DataFrame:
    """The best leaf's literal if it scores above zero. tasks: those of ``score``."""
    best = top_leaves(scored, 1).where("score > 0").select("qid", "value")
    return asked(questions, best, tasks).select("qid", F.coalesce("value", F.lit(nothing)).alias("answer"))


def collapse(top: DataFrame) -> DataFrame:
    """Candidates of equal value are one, with the best path and the number of paths that agree."""
    g = top.groupBy("qid", "value").agg(F.count("*").alias("n_paths"), F.min(F.struct("rank", "path", "score")).alias("b"))
    return g.select("qid", "value", "n_paths", F.col("b.rank").alias("rank"), F.array_join("b.path", ".").alias("path"), F.col("b.score").alias("score"))


def margin(collapsed: DataFrame) -> DataFrame:
    """The best value's lead over the next different one."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "rank")
    r = collapsed.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.lead("score").over(w))
    return r.where("_r = 1").select("qid", "value", (F.col("score") - F.coalesce("_next", F.lit(0.0))).alias("margin"))


def sanitise(candidates: DataFrame, bad_leaf: str | None = None, numeric_question: str | None = None) -> DataFrame:
    """Drop empty values, identifiers, bad leaves and words where a number is asked for, unless a question has nothing else."""
    good = (F.trim("value") != "") & ~F.regexp_like("value", F.lit("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"))
    if bad_leaf:
        good &= ~F.regexp_like(F.lower("path"), F.lit(bad_leaf))
    if numeric_question:
        good &= ~F.regexp_like("question", F.lit(numeric_question)) | F.regexp_like("value", F.lit(NUMBER))
    good = F.coalesce(good, F.lit(False))
    w = Window.partitionBy("qid")
    return candidates.withColumn("_any", F.max(good.cast("int")).over(w)).where(good | (F.col("_any") == 0)).drop("_any")


def aliases(teams: DataFrame) -> DataFrame:
    """alias to key: "market name", name, abbreviation, key in words; the first team in order, then the first form. teams: ord, key, market, name, abbr."""
    forms = [F.concat_ws(" ", "market", "name"), F.col("name"), F.col("abbr"), F.translate("key", "_", " ")]
    every = teams.select("ord", "key", F.posexplode(F.array(*[F.trim(F.lower(f)) for f in forms])).alias("kind", "alias")).where("alias != ''")
    return every.groupBy("alias").agg(F.min(F.struct("ord", "kind", "key")).alias("b")).select("alias", F.col("b.key").alias("key"))


def _asked_words(questions: DataFrame) -> DataFrame:
    """qid, question in lower case, and each of its words."""
    lower = F.lower("question")
    return questions.select("qid", lower.alias("q"), F.explode(F.array_distinct(F.regexp_extract_all(lower, F.lit("[a-z0-9]+"), F.lit(0)))).alias("word"))


def _meeting(words: DataFrame, table: DataFrame) -> DataFrame:
    """Words of questions with the rows of the table that hold them. A table of names that a sum proves small is broadcast; the words never are."""
    small = broadcast_if_small(table, NAMES_BYTES)
    return words.join(small, "word") if small is not table else words.hint("merge").join(table, "word")


def _whole(text: Column) -> Column:
    """A pattern for a text as whole words."""
    return F.concat(F.lit(r"\b\Q"), text, F.lit(r"\E\b"))


def mentions(questions: DataFrame, table: DataFrame) -> DataFrame:
    """Aliases found in questions as whole words, the longest at a place; those inside another are dropped.

    A question meets only the aliases whose first word it holds, by an equi-join: neither side need be small.
    """
    first = table.withColumn("word", F.regexp_extract("alias", "[a-z0-9]+", 0))
    j = _meeting(_asked_words(questions), first).where(F.contains("q", F.col("alias")))  # before a pattern is built for the row
    at = j.withColumn("at", F.regexp_instr("q", _whole(F.col("alias")))).where("at > 0").withColumn("end", F.col("at") + F.length("alias"))
    w = Window.partitionBy("qid")
    spans = at.withColumn("_all", F.collect_list(F.struct("at", "end")).over(w))  # a question's own mentions
    inside = F.exists("_all", lambda s: (s["at"] <= F.col("at")) & (s["end"] >= F.col("end")) & ((s["end"] - s["at"]) > (F.col("end") - F.col("at"))))
    return spans.where(~inside).select("qid", "key", "alias", "at")


def match_names(questions: DataFrame, names: DataFrame) -> DataFrame:
    """qid, slug: the longest name a question spells out, else the first whose surname follows a first name of which one is a prefix of the other.

    names: slug, ord. A question meets only the names whose last word it holds.
    """
    spelled = F.translate("slug", "_", " ")
    n = names.select("slug", "ord", spelled.alias("spelled"), F.element_at(F.split(spelled, " "), -1).alias("word"))
    j = _meeting(_asked_words(questions), n)
    exact = F.contains("q", F.col("spelled")) & F.regexp_like("q", _whole(F.col("spelled")))
    first, last = F.split("slug", "_", 2)[0], F.translate(F.get(F.split("slug", "_", 2), F.lit(1)), "_", " ")
    j = j.withColumn("_p", F.concat(F.lit(r"\b([a-z\u00c0-\u024f.'-]+)\s+\Q"), last, F.lit(r"\E\b")))
    said = F.expr("regexp_extract(q, _p, 1)")
    like = last.isNotNull() & (said != "") & (F.startswith(said, first) | F.startswith(first, said))
    j = j.withColumn("kind", F.when(exact, 0).when(like, 1)).where("kind is not null")
    w = Window.partitionBy("qid").orderBy("kind", F.when(F.col("kind") == 0, -F.length("spelled")), "ord")
    return j.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("qid", "slug")


def plain_words(text: Column) -> Column:
    """Lower case without signs, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", ""), " +", " "))


def missed_names(questions: DataFrame, names: DataFrame) -> DataFrame:
    """qid, slug: names of two words or more that a question holds once signs are gone from both."""
    n = names.select("slug", plain_words(F.translate("slug", "_", " ")).alias("spelled")).where(F.contains("spelled", F.lit(" "))).withColumn("word", F.substring_index("spelled", " ", 1))
    q = questions.select("qid", plain_words(F.col("question")).alias("q")).withColumn("word", F.explode(F.array_distinct(F.split("q", " "))))
    return _meeting(q, n).where(F.contains(F.concat(F.lit(" "), F.col("q"), F.lit(" ")), F.concat(F.lit(" "), F.col("spelled"), F.lit(" ")))).select("qid", "slug")


def league_route(questions: DataFrame, leaves: DataFrame) -> DataFrame:
    """qid, ord, path, value: injuries of the player, else standings of the team, where the question is about them. questions: qid, question, player, team."""
    q = F.lower("question")
    about = F.array(F.struct(F.lit(0).alias("turn"), F.lit("injuries").alias("part"), F.when(F.contains(q, F.lit("injur")), F.col("player")).alias("who")), F.struct(F.lit(1).alias("turn"), F.lit("standings").alias("part"), F.when(F.regexp_like(q, F.lit("|".join(STANDINGS))), F.col("team")).alias("who")))
    asks = questions.select("qid", F.explode(about).alias("a")).where("a.who is not null").select("qid", "a.*")
    lower = F.transform("path", lambda p: F.lower(p))
    held = leaves.select("ord", "path", "value", F.explode(F.array_distinct(lower)).alias("who"), lower.alias("_l"))
    found = asks.join(held, "who").where(F.array_contains("_l", F.col("part")))
    w = Window.partitionBy("qid")
    return found.withColumn("_t", F.min("turn").over(w)).where("turn = _t").select("qid", "ord", "path", "value")


def game_on(leaves: DataFrame, asks: DataFrame) -> DataFrame:
    """qid, game: the segment of the first ``scheduled`` leaf on the day. asks: qid, entity, day (ISO text)."""
    game = F.get(F.filter("path", lambda p: F.contains(p, F.lit("matches ago")) | (p == "previous match")), F.lit(0))
    at = leaves.where(F.element_at("path", -1) == "scheduled").select("entity", "ord", F.substring("value", 1, 10).alias("day"), game.alias("game")).where("game is not null")
    return asks.join(at, ["entity", "day"]).groupBy("qid").agg(F.min(F.struct("ord", "game")).alias("b")).select("qid", F.col("b.game").alias("game"))


def audit(new: DataFrame, old: DataFrame, nothing: str = "no answer") -> DataFrame:
    """By leaf: answers, answers that changed since the old run, and questions without one. new, old: qid, path, answer."""
    j = new.join(old.select("qid", F.col("answer").alias("_old")), "qid", "left")
    leaf = F.element_at(F.split("path", "[.]"), -1)
    return j.groupBy(leaf.alias("leaf")).agg(F.count("*").alias("n"), F.count_if(~F.col("answer").eqNullSafe(F.col("_old"))).alias("changed"), F.count_if(F.lower(F.trim("answer")) == nothing).alias("none"))


def predicted_delta(new: DataFrame, old: DataFrame, split: float, conversions: tuple = (0.3, 0.55, 0.8)) -> DataFrame:
    """Answers that changed, how many of them are likely to be scored, and the gain at low, middle and high conversion."""
    n = new.join(old.select("qid", F.col("answer").alias("_old")), "qid").agg(F.count_if(F.col("answer") != F.col("_old")).alias("changed"))
    scored = F.col("changed") * split
    return n.select("changed", scored.alias("scored"), *[(scored * c).alias(k) for k, c in zip(("low", "mid", "high"), conversions, strict=True)])


def subject(found: DataFrame, questions: DataFrame) -> DataFrame:
    """The team a question is about: the first mention before "against", else the first one."""
    j = found.hint("merge").join(questions.select("qid", F.expr("nullif(regexp_instr(lower(question), '\\\\bagainst\\\\b'), 0)").alias("cut")), "qid")
    w = Window.partitionBy("qid").orderBy(F.when(F.col("cut").isNull() | (F.col("at") < F.col("cut")), 0).otherwise(1), "at", "key")
    return j.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("qid", "key")


def deepest_prefix(leaves: DataFrame, nodes: DataFrame, tasks: int | None = None) -> DataFrame:
    """Each leaf with its longest enclosing node. nodes: entity, node (path). tasks: as for ``score``."""
    n = tasks or _tasks(leaves.count())
    if not tasks:
        leaves, nodes = spread(leaves, n), spread(nodes, n)
    nodes = nodes.repartition(n, "entity").select(F.col("entity").alias("_of"), "node").hint("merge")  # both may come from one table
    j = leaves.repartition(n, "entity").join(nodes, (F.col("entity") == F.col("_of")) & (F.slice("path", F.lit(1), F.size("node")) == F.col("node")), "left").drop("_of")
    w = Window.partitionBy("entity", "ord").orderBy(F.desc(F.size("node")))
    return j.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def sides(leaves: DataFrame) -> DataFrame:
    """Home and away names of game nodes from their market and name leaves."""
    part = leaves.where(F.element_at("path", -1).isin("market", "name") & (F.size("path") > 2) & F.try_element_at("path", F.lit(-2)).isin("home", "away"))
    wide = part.select("entity", F.slice("path", F.lit(1), F.size("path") - 2).alias("node"), F.element_at("path", -2).alias("side"), F.element_at("path", -1).alias("leaf"), "value")
    wide = wide.groupBy("entity", "node").agg(*[F.max(F.when((F.col("side") == s) & (F.col("leaf") == leaf), F.col("value"))).alias(f"{s}_{leaf}") for s in ("home", "away") for leaf in ("market", "name")])
    return wide.select("entity", "node", F.concat_ws(" ", "home_market", "home_name").alias("home"), F.concat_ws(" ", "away_market", "away_name").alias("away"))


def votes(table: DataFrame) -> DataFrame:
    """qid, choice: the choice with most votes and its share, ties to the smaller choice."""
    g = table.groupBy("qid", "choice").agg(F.count("*").alias("n"))
    w = Window.partitionBy("qid")
    r = g.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("n"), "choice")))
    return r.where("_r = 1").select("qid", "choice", "share")


def snap(texts: DataFrame, values: DataFrame) -> DataFrame:
    """Free text to a stored value: equal, else the longest contained, else equal without signs, else nothing. texts: qid, text; values: qid, value."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    j = texts.join(values, "qid")
    how = F.when(F.col("text") == F.col("value"), 0).when(F.contains("text", "value"), 1).when(plain("text") == plain("value"), 2)
    w = Window.partitionBy("qid").orderBy("how", F.desc(F.length("value")), "value")
    best = j.withColumn("how", how).where("how is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1").select("qid", "value")
    return texts.select("qid").join(best, "qid", "left")
