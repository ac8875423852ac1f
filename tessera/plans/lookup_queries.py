"""Queries on nested documents: leaves of parts, questions about them, names and choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.operators import jsonkb as kb
from tessera.plans.registry import register
from tessera.runtime import table

#: (path, value) of each part's leaves, in document order; a segment or value in braces is a column.
LEAVES = [
    (["stats", "2023", "size"], "{p_size}"), (["stats", "2024", "size"], "{p_size} + 1"), (["info", "brand_name"], "{p_brand}"), (["info", "alias", "brand"], "{p_brand}"),
    (["splits", "month", "june", "price"], "{p_retailprice}"), (["splits", "month", "may", "price"], "{p_retailprice} + 1"), (["{p_type}", "total_size"], "{p_size} * 2"), (["history", "{p_brand}", "sizes"], "{p_size} + 3"),
]
QUESTIONS = ["What was the size in 2024?", "Which brand is it?", "What was the price in June?", "How many economy sizes are there in total?", "What alias of the brand did it have in 2023?"]


def _parts(s, d) -> DataFrame:
    """Parts as entities."""
    return table(s, d, "part").withColumn("entity", F.col("p_partkey").cast("string"))


def _leaves_of(parts: DataFrame) -> DataFrame:
    plain = lambda x: F.expr(x.replace("{", "").replace("}", ""))
    rows = [F.struct(F.lit(i).alias("ord"), F.array(*[plain(x) if "{" in x else F.lit(x) for x in path]).alias("path"), plain(f"cast({value} as string)").alias("value")) for i, (path, value) in enumerate(LEAVES)]
    return parts.select("entity", F.explode(F.array(*rows)).alias("l")).select("entity", "l.*")


def _leaves(s, d) -> DataFrame:
    return _leaves_of(_parts(s, d))


def _questions_of(parts: DataFrame) -> DataFrame:
    text = F.element_at(F.array(*[F.lit(q) for q in QUESTIONS]), (F.col("p_partkey") % len(QUESTIONS) + 1).cast("int"))
    return parts.select(F.col("p_partkey").alias("qid"), "entity", text.alias("question"))


def _questions(s, d) -> DataFrame:
    return _questions_of(_parts(s, d))


def _sql_leaf(i: int, path: list[str], value: str) -> str:
    plain = lambda x: x.replace("{", "").replace("}", "")
    return f"SELECT p_partkey AS qid, {i} AS ord, [{', '.join(plain(x) if '{' in x else repr(x) for x in path)}] AS path, CAST({plain(value)} AS VARCHAR) AS value FROM part"


_WORDS = f"list_filter(regexp_split_to_array(lower(question), '[^a-z0-9_\\-]+'), lambda t: t <> '' AND NOT list_contains({kb.STOP_WORDS!r}, t))"
#: The score written out for the other engine.
_SCORED = f"""leaves AS ({" UNION ALL ".join(_sql_leaf(i, *leaf) for i, leaf in enumerate(LEAVES))}),
asked AS (SELECT p_partkey AS qid, ({QUESTIONS!r})[p_partkey % {len(QUESTIONS)} + 1] AS question FROM part),
words AS (SELECT qid, {_WORDS} AS raw FROM asked),
parts AS (SELECT qid, ord, path, value, raw, list_filter(raw, lambda t: regexp_full_match(t, '(19|20)[0-9][0-9]')) AS ya, list_filter(path, lambda t: regexp_full_match(t, '(19|20)[0-9][0-9]')) AS yh,
  list_intersect(raw, {kb.MONTHS!r}) AS ma, list_transform(path, lambda t: lower(t)) AS low FROM leaves JOIN words USING (qid)),
scored AS (SELECT qid, ord, array_to_string(path, '.') AS path, path AS segments, value, raw, ya,
  list_sum(list_transform(range(1, len(path) + 1), lambda i: (1 + (i - 1) / greatest(len(path) - 1, 1)) * list_sum(list_transform(list_filter(regexp_split_to_array(lower(path[i]), '[_\\s]+'), lambda t: t <> ''), lambda t: CASE WHEN list_contains(raw, t) THEN 2.0
    WHEN length(t) > 3 AND len(list_filter(raw, lambda q: contains(q, t) OR contains(t, q))) > 0 THEN 0.8 ELSE 0.0 END))))
  + CASE WHEN len(ya) = 0 OR len(yh) = 0 THEN 0 WHEN list_has_any(ya, yh) THEN 6 ELSE -6 END
  + CASE WHEN len(ma) = 0 THEN 0 WHEN list_has_any(low, ma) THEN 6 WHEN list_has_any(low, {kb.MONTHS!r}) OR list_contains(low, 'month') THEN -6 ELSE 0 END AS score FROM parts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, ord) AS rank FROM scored),
one AS (SELECT qid, value, count(*) AS n_paths, min(rank) AS rank, arg_min(path, rank) AS path, arg_min(score, rank) AS score FROM ranked WHERE rank <= 4 GROUP BY 1, 2),"""


def _scored_in(s, d, rules: list | None = None) -> tuple[DataFrame, int]:
    parts, n = kb.dealt(_parts(s, d), len(LEAVES))
    return kb.score(_leaves_of(parts), _questions_of(parts), rules, tasks=n), n


def _scored(s, d, rules: list | None = None) -> DataFrame:
    return _scored_in(s, d, rules)[0]


def _answers(s, d) -> DataFrame:
    scored, n = _scored_in(s, d)
    return kb.answers(scored, _questions(s, d), tasks=n)


def _dotted(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.array_join("path", "."))


register("leaf_topk", "qid path:s value:s score:f rank", lambda s, d: _dotted(kb.top_leaves(_scored(s, d), 3)), "SELECT * FROM ranked WHERE rank <= 3", _SCORED)
register(
    "guarded_filter", "qid path:s value:s", lambda s, d: _dotted(kb.guarded(_scored(s, d), F.exists("path", lambda x: F.regexp_like(x, F.lit(kb.YEAR)) & ~F.array_contains("raw", x)) & F.exists("raw", lambda x: F.regexp_like(x, F.lit(kb.YEAR))))),
    """SELECT qid, path, value FROM (SELECT *, len(ya) > 0 AND len(list_filter(segments, lambda t: regexp_full_match(t, '(19|20)[0-9][0-9]') AND NOT list_contains(raw, t))) > 0 AS wrong FROM scored)
    QUALIFY NOT wrong OR NOT bool_or(NOT wrong) OVER (PARTITION BY qid, segments[-1])""", _SCORED,
)
register("value_collapse", "qid value:s n_paths rank path:s score:f", lambda s, d: kb.collapse(kb.top_leaves(_scored(s, d), 4)), "SELECT * FROM one", _SCORED)
register(
    "leaf_answers", "qid answer:s", _answers,
    "SELECT asked.qid, coalesce(value, 'no answer') AS answer FROM asked LEFT JOIN (SELECT qid, value FROM ranked WHERE rank = 1 AND score > 0) USING (qid)", _SCORED,
)
register(
    "score_margin", "qid value:s margin:f", lambda s, d: kb.margin(kb.collapse(kb.top_leaves(_scored(s, d), 4))),
    "SELECT qid, value, score - coalesce(nxt, 0) AS margin FROM (SELECT *, lead(score) OVER w AS nxt, row_number() OVER w AS r FROM one WINDOW w AS (PARTITION BY qid ORDER BY score DESC, rank)) WHERE r = 1", _SCORED,
)
register(
    "additive_rules", "qid path:s value:s score:f rank", lambda s, d: _dotted(kb.top_leaves(_scored(s, d, [(F.element_at("path", -1) == "size", 3.0), (F.array_contains("path", "alias"), -1.5)]), 2)),
    "SELECT qid, path, value, score + b AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score + b, 6) DESC, ord) AS rank FROM (SELECT *, CASE WHEN segments[-1] = 'size' THEN 3.0 ELSE 0 END + CASE WHEN list_contains(segments, 'alias') THEN -1.5 ELSE 0 END AS b FROM scored) QUALIFY rank <= 2", _SCORED,
)
register(
    "synonym_words", "qid words:s", lambda s, d: _questions(s, d).select("qid", F.array_join(F.array_sort(kb.expand_synonyms(kb.tokens(F.col("question")), {"price": ["cost", "worth"], "brand": ["maker"]})), " ").alias("words")),
    "SELECT qid, array_to_string(list_sort(list_distinct(list_concat(list_concat(raw, CASE WHEN list_contains(raw, 'price') THEN ['cost', 'worth'] ELSE [] END), CASE WHEN list_contains(raw, 'brand') THEN ['maker'] ELSE [] END))), ' ') AS words FROM words", _SCORED,
)
register(
    "audit_diff", "leaf:s n changed none", lambda s, d: kb.audit(_audited(s, d, []), _audited(s, d, [(F.array_contains("path", "alias"), 9.0)])),
    """SELECT string_split(coalesce(a.path, '-'), '.')[-1] AS leaf, count(*) AS n, count(*) FILTER (a.answer IS DISTINCT FROM b.answer) AS changed, count(*) FILTER (lower(trim(a.answer)) = 'no answer') AS none FROM run a LEFT JOIN run2 b USING (qid) GROUP BY 1""",
    _SCORED + """run AS (SELECT asked.qid, coalesce(path, '-') AS path, coalesce(value, 'no answer') AS answer FROM asked LEFT JOIN (FROM ranked WHERE rank = 1 AND score > 0) r USING (qid)),
    run2 AS (SELECT asked.qid, coalesce(value, 'no answer') AS answer FROM asked LEFT JOIN (SELECT qid, value FROM (SELECT *, score + CASE WHEN list_contains(segments, 'alias') THEN 9 ELSE 0 END AS s2 FROM scored) WHERE s2 > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(s2, 6) DESC, ord) = 1) USING (qid)),""",
)
register(
    "predicted_delta", "changed scored:f low:f mid:f high:f", lambda s, d: kb.predicted_delta(_audited(s, d, []), _audited(s, d, [(F.array_contains("path", "2023"), 20.0)]), 0.42),
    "SELECT n AS changed, n * 0.42 AS scored, n * 0.42 * 0.3 AS low, n * 0.42 * 0.55 AS mid, n * 0.42 * 0.8 AS high FROM (SELECT count(*) FILTER (a.value <> b.value) AS n FROM best a JOIN best2 b USING (qid))",
    _SCORED + """best AS (SELECT asked.qid, coalesce(value, 'no answer') AS value FROM asked LEFT JOIN (FROM ranked WHERE rank = 1 AND score > 0) r USING (qid)),
    best2 AS (SELECT asked.qid, coalesce(value, 'no answer') AS value FROM asked LEFT JOIN (SELECT qid, value FROM (SELECT *, score + CASE WHEN list_contains(segments, '2023') THEN 20 ELSE 0 END AS s2 FROM scored) WHERE s2 > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(s2, 6) DESC, ord) = 1) USING (qid)),""",
)


def _audited(s, d, rules) -> DataFrame:
    scored, n = _scored_in(s, d, rules)
    best = kb.top_leaves(scored, 1).where("score > 0").select("qid", F.array_join("path", ".").alias("path"), "value")
    return kb.asked(_questions(s, d), best, n).select("qid", F.coalesce("path", F.lit("-")).alias("path"), F.coalesce("value", F.lit("no answer")).alias("answer"))


# names of teams and players
def _teams(s, d) -> DataFrame:
    """Nations as teams: market from the region, names such as Nation 7."""
    n, r = table(s, d, "nation"), table(s, d, "region")
    j = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.col("n_nationkey").alias("ord"), F.lower("n_name").alias("key"), F.initcap("r_name").alias("market"), F.initcap(F.translate("n_name", "_", " ")).alias("name"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string"), F.lit("X")).alias("abbr"))


def _team_questions(s, d) -> DataFrame:
    c, a, b = table(s, d, "customer"), F.col("c_nationkey"), ((F.col("c_custkey") + F.col("c_nationkey")) % 25)
    say = F.when(F.col("c_custkey") % 3 == 0, F.format_string("How many wins did Nation %d have against the Nation %d?", a, b)).when(F.col("c_custkey") % 3 == 1, F.format_string("Against N%dX, what did nation %d score?", b, a)).otherwise(F.format_string("Is nation %d-led N%dX any good", a, b))
    return c.select(F.col("c_custkey").alias("qid"), say.alias("question"))


_TEAMS = """teams AS (SELECT n_nationkey AS ord, lower(n_name) AS key, lower(r_name) || ' ' || lower(replace(n_name, '_', ' ')) AS f0, lower(replace(n_name, '_', ' ')) AS f1, 'n' || n_nationkey || 'x' AS f2, lower(replace(n_name, '_', ' ')) AS f3 FROM nation JOIN region ON n_regionkey = r_regionkey),
al AS (SELECT alias, arg_min(key, ord * 10 + kind) AS key FROM (SELECT ord, key, unnest([f0, f1, f2, f3]) AS alias, unnest([0, 1, 2, 3]) AS kind FROM teams) GROUP BY 1),
tq AS (SELECT c_custkey AS qid, lower(CASE c_custkey % 3 WHEN 0 THEN 'How many wins did Nation ' || c_nationkey || ' have against the Nation ' || ((c_custkey + c_nationkey) % 25) || '?' WHEN 1 THEN 'Against N' || ((c_custkey + c_nationkey) % 25) || 'X, what did nation ' || c_nationkey || ' score?'
  ELSE 'Is nation ' || c_nationkey || '-led N' || ((c_custkey + c_nationkey) % 25) || 'X any good' END) AS q FROM customer),
hit AS (SELECT qid, q, key, alias, length(regexp_extract(q, '^(.*?)\\b' || alias || '\\b', 1)) + 1 AS pos FROM tq, al WHERE regexp_matches(q, '\\b' || alias || '\\b')),
men AS (SELECT * FROM hit a WHERE NOT EXISTS (SELECT 1 FROM hit b WHERE a.qid = b.qid AND b.pos <= a.pos AND b.pos + length(b.alias) >= a.pos + length(a.alias) AND length(b.alias) > length(a.alias))),"""
register("team_aliases", "alias:s key:s", lambda s, d: kb.aliases(_teams(s, d)), "SELECT alias, key FROM al", _TEAMS)
register("team_mentions", "qid key:s alias:s pos", lambda s, d: kb.mentions(_team_questions(s, d), kb.aliases(_teams(s, d))).withColumnRenamed("at", "pos"), "SELECT qid, key, alias, pos FROM men", _TEAMS)
register(
    "question_subject", "qid key:s", lambda s, d: kb.subject(kb.mentions(_team_questions(s, d), kb.aliases(_teams(s, d))), _team_questions(s, d)),
    "SELECT qid, key FROM (SELECT *, CASE WHEN position('against' IN q) = 0 OR pos < position('against' IN q) THEN 0 ELSE 1 END AS side FROM men) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY side, pos, key) = 1", _TEAMS,
)


def _names(s, d) -> DataFrame:
    p = table(s, d, "part").groupBy(kb.slug(F.col("p_name")).alias("slug")).agg(F.min("p_partkey").alias("ord"))
    return p.select("slug", "ord")


def _name_questions(s, d) -> DataFrame:
    name, k = F.col("p_name"), F.col("p_partkey") % 4
    first, last = F.split(name, " ")[0], F.split(name, " ")[1]
    say = F.when(k == 0, F.concat(F.lit("How old is "), F.initcap(name), F.lit("?"))).when(k == 1, F.concat(F.lit("Did "), first, F.lit("ie "), last, F.lit(" win?"))).when(k == 2, F.concat(F.lit("What of "), F.substring(first, 1, 2), F.lit(" "), last, F.lit(" now"))).otherwise(F.concat(F.lit("And "), first, F.lit("' "), F.substring(last, 1, 1), F.lit("-"), F.substring(last, 2, 99), F.lit("?")))
    return table(s, d, "part").select(F.col("p_partkey").alias("qid"), say.alias("question"))


_NAMES = """names AS (SELECT replace(p_name, ' ', '_') AS slug, p_name AS spelled, min(p_partkey) AS ord, split_part(p_name, ' ', 1) AS fst, split_part(p_name, ' ', 2) AS lst FROM part GROUP BY p_name),
nq AS (SELECT p_partkey AS qid, lower(CASE p_partkey % 4 WHEN 0 THEN 'How old is ' || p_name || '?' WHEN 1 THEN 'Did ' || split_part(p_name, ' ', 1) || 'ie ' || split_part(p_name, ' ', 2) || ' win?' WHEN 2 THEN 'What of ' || split_part(p_name, ' ', 1)[1:2] || ' ' || split_part(p_name, ' ', 2) || ' now'
  ELSE 'And ' || split_part(p_name, ' ', 1) || ''' ' || split_part(p_name, ' ', 2)[1:1] || '-' || split_part(p_name, ' ', 2)[2:] || '?' END) AS q FROM part),
nm AS (SELECT qid, slug, ord, length(spelled) AS n, regexp_matches(q, '\\b' || spelled || '\\b') AS exact, fst, regexp_extract(q, '\\b([a-z.''-]+)\\s+' || lst || '\\b', 1) AS said FROM nq, names),"""
register(
    "entity_match", "qid slug:s", lambda s, d: kb.match_names(_name_questions(s, d), _names(s, d)),
    "SELECT qid, slug FROM nm WHERE exact OR (said <> '' AND (starts_with(said, fst) OR starts_with(fst, said))) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY NOT exact, CASE WHEN exact THEN -n END, ord) = 1", _NAMES,
)
register(
    "missed_names", "qid slug:s", lambda s, d: kb.missed_names(_name_questions(s, d), _names(s, d)),
    "SELECT qid, slug FROM (SELECT qid, ' ' || trim(regexp_replace(regexp_replace(q, '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) || ' ' AS q FROM nq), names WHERE contains(q, ' ' || spelled || ' ')", _NAMES,
)


# league tables, games and choices
def _league(s, d) -> DataFrame:
    p = table(s, d, "part").where("p_name is not null")
    inj = p.groupBy(kb.slug(F.col("p_name")).alias("who")).agg(F.min("p_partkey").alias("ord"), F.max("p_size").alias("v")).select("ord", F.array(F.lit("league"), F.lit("Injuries"), F.col("who"), F.lit("days")).alias("path"), F.col("v").cast("string").alias("value"))
    n = table(s, d, "nation").select((F.col("n_nationkey") + 1_000_000).alias("ord"), F.array(F.lit("league"), F.lit("standings"), F.col("n_name"), F.lit("games_back")).alias("path"), F.col("n_regionkey").cast("string").alias("value"))
    return inj.unionByName(n)


def _league_questions(s, d) -> DataFrame:
    k, p = F.col("p_partkey") % 3, table(s, d, "part")
    text = F.when(k == 0, "How long is the injury list?").when(k == 1, "Who leads the wild card?").otherwise("How tall is he?")
    return p.select(F.col("p_partkey").alias("qid"), text.alias("question"), F.when(F.col("p_partkey") % 5 != 0, kb.slug(F.col("p_name"))).alias("player"), F.concat(F.lit("nation_"), (F.col("p_partkey") % 25).cast("string")).alias("team"))


register(
    "league_route", "qid path:s value:s", lambda s, d: _dotted(kb.league_route(_league_questions(s, d), _league(s, d))),
    """SELECT p_partkey AS qid, 'league.Injuries.' || slug || '.days' AS path, CAST(v AS VARCHAR) AS value FROM part JOIN (SELECT p_name, replace(p_name, ' ', '_') AS slug, max(p_size) AS v FROM part GROUP BY 1) USING (p_name) WHERE p_partkey % 3 = 0 AND p_partkey % 5 <> 0
    UNION ALL SELECT p_partkey, 'league.standings.' || n_name || '.games_back', CAST(n_regionkey AS VARCHAR) FROM part JOIN nation ON n_nationkey = p_partkey % 25 WHERE p_partkey % 3 = 1""",
)


def _games(s, d) -> DataFrame:
    """Orders of a customer as games: scheduled, home and away leaves."""
    o = table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("entity"), F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    game = F.concat((F.col("k") % 9).cast("string"), F.lit(" matches ago"))
    leaf = lambda i, path, v: F.struct((F.col("k") * 10 + i).alias("ord"), F.array(*path).alias("path"), v.alias("value"))
    base = [F.lit("last_10_games"), game]
    rows = F.array(leaf(0, [*base, F.lit("scheduled")], F.concat("day", F.lit("T19:05:00"))), *[leaf(1 + 2 * i + j, [F.lit("games"), F.col("k").cast("string"), F.lit(side), F.lit(what)], F.concat(F.lit(f"{side[0]}{what[0]}"), (F.col("k") % 7 + i).cast("string"))) for i, side in enumerate(("home", "away")) for j, what in enumerate(("market", "name"))])
    return o.select("entity", F.explode(rows).alias("l")).select("entity", "l.*")


register(
    "game_on_day", "qid game:s", lambda s, d: kb.game_on(_games(s, d), table(s, d, "orders").select(F.col("o_orderkey").alias("qid"), F.col("o_custkey").cast("string").alias("entity"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))),
    "SELECT a.o_orderkey AS qid, CAST(min(b.o_orderkey) % 9 AS VARCHAR) || ' matches ago' AS game FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND CAST(a.o_orderdate AS DATE) = CAST(b.o_orderdate AS DATE) GROUP BY 1",
)
register(
    "game_sides", "entity:s node:s home:s away:s", lambda s, d: kb.sides(_games(s, d)).withColumn("node", F.array_join("node", ".")),
    "SELECT o_custkey AS entity, 'games.' || o_orderkey AS node, 'hm' || (o_orderkey % 7) || ' hn' || (o_orderkey % 7) AS home, 'am' || (o_orderkey % 7 + 1) || ' an' || (o_orderkey % 7 + 1) AS away FROM orders",
)
register(
    "deepest_prefix", "entity:s ord node:s", lambda s, d: _deepest(s, d).withColumn("node", F.array_join("node", ".")),
    "SELECT qid AS entity, ord, node FROM leaves LEFT JOIN (SELECT p_partkey AS k, unnest(['splits', 'splits.month', 'splits.month.june', 'info']) AS node FROM part) ON k = qid AND starts_with(array_to_string(path, '.') || '.', node || '.') QUALIFY row_number() OVER (PARTITION BY qid, ord ORDER BY length(node) DESC NULLS LAST) = 1", _SCORED,
)


def _nodes_of(parts: DataFrame) -> DataFrame:
    nodes = F.array(*[F.array(*map(F.lit, n)) for n in (["splits"], ["splits", "month"], ["splits", "month", "june"], ["info"])])
    return parts.select("entity", F.explode(nodes).alias("node"))


def _nodes(s, d) -> DataFrame:
    return _nodes_of(_parts(s, d))


def _deepest(s, d) -> DataFrame:
    parts, n = kb.dealt(_parts(s, d), len(LEAVES))
    return kb.deepest_prefix(_leaves_of(parts), _nodes_of(parts), tasks=n)


register(
    "permutation_votes", "qid choice:s share:f", lambda s, d: kb.votes(table(s, d, "events").select(F.col("user_id").alias("qid"), F.col("event_type").alias("choice"))),
    "SELECT user_id AS qid, event_type AS choice, n / t AS share FROM (SELECT user_id, event_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY user_id) AS t FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1",
)


def _free_text(s, d) -> DataFrame:
    k, b = F.col("p_partkey") % 4, F.col("p_brand")
    return table(s, d, "part").select(F.col("p_partkey").alias("qid"), F.when(k == 0, b).when(k == 1, F.concat(F.lit("it is "), b, F.lit(" I think"))).when(k == 2, F.lower(F.translate(b, "#", " "))).otherwise("nothing").alias("text"))


register(
    "snap_to_value", "qid value:s", lambda s, d: kb.snap(_free_text(s, d), table(s, d, "part").select(F.col("p_partkey").alias("qid"), F.explode(F.array("p_brand", F.substring("p_brand", 1, 7), "p_type")).alias("value"))),
    """SELECT q.qid, value FROM (SELECT p_partkey AS qid FROM part) q LEFT JOIN (SELECT t.qid, value, CASE WHEN text = value THEN 0 WHEN contains(text, value) THEN 1 WHEN regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') = regexp_replace(lower(value), '[^a-z0-9]+', '', 'g') THEN 2 END AS how
    FROM (SELECT p_partkey AS qid, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN 'it is ' || p_brand || ' I think' WHEN 2 THEN lower(replace(p_brand, '#', ' ')) ELSE 'nothing' END AS text FROM part) t
    JOIN (SELECT p_partkey AS qid, unnest([p_brand, p_brand[1:7], p_type]) AS value FROM part) v USING (qid) WHERE how IS NOT NULL QUALIFY row_number() OVER (PARTITION BY t.qid ORDER BY how, length(value) DESC, value) = 1) b USING (qid)""",
)
register(
    "sanitised", "qid path:s value:s", lambda s, d: kb.sanitise(_dotted(_scored(s, d)), r"\.alias\.", "(?i)how many|size|price").select("qid", "path", "value"),
    """SELECT qid, path, value FROM (SELECT s.*, trim(value) <> '' AND NOT regexp_matches(lower(path), '\\.alias\\.') AND (NOT regexp_matches(question, '(?i)how many|size|price') OR TRY_CAST(replace(value, ',', '') AS DOUBLE) IS NOT NULL) AS good FROM scored s JOIN asked USING (qid))
    QUALIFY good OR NOT bool_or(good) OVER (PARTITION BY qid)""", _SCORED,
)
register(
    "path_suffix", "qid path:s", lambda s, d: _suffixed(s, d), "SELECT qid, array_to_string(path, '.') AS path FROM leaves WHERE ends_with('.' || array_to_string(path, '.'), '.month.june.price')", _SCORED,
)


def _suffixed(s, d) -> DataFrame:
    from tessera.functions import suffix_match

    return _dotted(_leaves(s, d).where(suffix_match(F.col("path"), "month.june.price"))).select(F.col("entity").cast("long").alias("qid"), "path")
