"""Registered queries over the driver's tables, with their SQL equivalents.

Every query runs over whole tables and whole texts and returns scalars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emendra.functions import changes as C
from emendra.functions import render as R
from emendra.functions import text as T
from emendra.operators import diff as D
from emendra.operators import pairs as P
from emendra.plans import sqltext as S

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    """Register a function under its name, with its SQL if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- pair sets: each conversation turn against the next, each benchmark item against the next


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, conv_id, turn, source, test), dealt out evenly: matching is the costly part, and files are few.

    Both sides are dealt out by the join's keys, which spread a long conversation, and stay so.
    """
    turns = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("test")).repartition(parts, "conv_id", "turn")
    pairs = turns.withColumnRenamed("text", "source").repartition(parts, "conv_id", "turn").hint("merge").join(following, ["conv_id", "turn"])
    return pairs.select(F.concat_ws("/", "conv_id", "turn").alias("id"), "conv_id", "turn", "source", "test")


TURNS = "SELECT a.conv_id || '/' || a.turn AS id, a.text AS source, b.text AS test FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"
OPS = f"WITH RECURSIVE {S.operations(TURNS)}"
OPS_TEXTS = f"{OPS}, {S.TEXTS}"
OPS_STATS = f"{OPS_TEXTS}, {S.STATS}"


def _turn_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.diff_pairs(turn_pairs(spark, sf_dir))


def _turn_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_changes(_turn_diffs(spark, sf_dir)).withColumn("stats", C.stats())


# --- sources and literals

LITERALS = [
    ("The quick brown fox jumps over the lazy dog.", "The quick brown fox walks past the lazy dog."),
    ("A B C D E", "A X C E F"),
    ("Hello\n\nWorld", "Hello\n \nEarth (new)"),
    ("a\nb", ""),
    ("", "added"),
    ("   ", "   "),
    ("Hello 世界", "Hello \U0001f30d"),
    ("one  two three", "one two three"),
    ("x ¶ y", "x ¶ z"),
]
LITERALS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"(CAST({k} AS BIGINT), {S.quoted(a)}, {S.quoted(b)})" for k, (a, b) in enumerate(LITERALS)) + ") v(id, source, test)"


def literal_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(LITERALS)], "id long, source string, test string")


@_query(f"WITH RECURSIVE {S.operations(LITERALS_SQL)}, {S.TEXTS}, {S.STATS} SELECT id, {S.STATS_COLUMNS} FROM stats")
def pairs_literal(spark, sf_dir):
    found = C.with_changes(D.diff_pairs(literal_pairs(spark)))
    # the one raw-equal pair of blanks has no changes either way
    return found.withColumn("stats", C.stats()).select("id", "stats.*").drop("levenshtein_distance")


PAGES_OF = "SELECT item_id, string_split(text, chr(10)) AS ps FROM benchmark"


def _paged(spark, sf_dir):
    """Synthetic paged documents: the lines of each benchmark item."""
    from emendra.sources.pdf import pages_of

    return _table(spark, sf_dir, "benchmark").select("item_id", pages_of(F.split("text", "\n", -1)).alias("pages"))


@_query(rf"""SELECT item_id, array_to_string(ps, chr(10) || chr(10)) AS text,
        array_to_string(list_transform(ps, lambda x, k: CASE WHEN {S.strip('x')} <> '' THEN '[Page ' || k || ']' || chr(10) || x ELSE x END), chr(10) || chr(10)) AS marked FROM ({PAGES_OF})""")
def pdf_page_join(spark, sf_dir):
    from emendra.sources.pdf import join_pages

    return _paged(spark, sf_dir).select("item_id", join_pages("pages").alias("text"), join_pages("pages", preserve_pages=True).alias("marked"))


@_query(f"SELECT item_id, CAST(generate_subscripts(ps, 1) AS INTEGER) AS page_number, unnest(ps) AS text, CAST(len(ps) AS INTEGER) AS page_count FROM ({PAGES_OF})")
def pdf_pages(spark, sf_dir):
    return _paged(spark, sf_dir).select("item_id", F.size("pages").alias("page_count"), F.inline("pages")).select("item_id", "page_number", "text", "page_count")


@_query(f"SELECT item_id, CAST(k AS INTEGER) AS page_number FROM (SELECT item_id, generate_subscripts(ps, 1) AS k, unnest(ps) AS t FROM ({PAGES_OF})) WHERE contains(t, 'th')")
def pdf_page_filter(spark, sf_dir):
    return _paged(spark, sf_dir).select("item_id", F.explode(F.filter("pages", lambda p: F.contains(p["text"], F.lit("th"))))).select("item_id", "col.page_number")


HEX = ["48656c6c6f", "e9e8", "c3a9", "", "f09f8c8d", "c080", "eda080", "e4b896e7"]


@_query("SELECT bytes, TRY(decode(unhex(bytes))) IS NOT NULL AS is_valid FROM (VALUES " + ", ".join(f"('{h}')" for h in HEX) + ") v(bytes)")
def utf8_status(spark, sf_dir):
    from emendra.sources.text_files import decoded

    rows = spark.createDataFrame([(h,) for h in HEX], "bytes string")
    return rows.select("bytes", (decoded(F.unhex("bytes"))["status"] == "ok").alias("is_valid"))


# --- text preparation, over all documents


@_query(f"SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS pos, unnest(ps) AS paragraph FROM (SELECT doc_id, {S.paragraphs('text')} AS ps FROM documents)")
def split_paragraphs(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("pos", "paragraph"))


@_query(f"SELECT doc_id, CAST(len({S.paragraphs('text')}) AS INTEGER) AS n FROM documents")
def paragraph_count(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.size(T.paragraphs(F.col("text"))).alias("n"))


@_query(f"SELECT doc_id, {S.marked('text')} AS marked FROM documents")
def mark_paragraphs(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.mark_paragraphs(F.col("text")).alias("marked"))


@_query(f"SELECT doc_id, {S.unmark(S.marked('text'))} AS text FROM documents")
def unmark_paragraphs(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.unmark(T.mark_paragraphs(F.col("text"))).alias("text"))


@_query(f"SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS pos, unnest(ps) AS part FROM (SELECT doc_id, string_split({S.marked('text')}, '¶ ') AS ps FROM documents)")
def split_marks(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.split_at_mark(T.mark_paragraphs(F.col("text")))).alias("pos", "part"))


DOC_TOKENS = f"SELECT doc_id, {S.tokens(S.marked('text'))} AS ts FROM documents"


def _tokens(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.tokenize(T.mark_paragraphs(F.col("text"))).alias("tokens"))


def _keys(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.keys(T.mark_paragraphs(F.col("text"))).alias("keys"))


@_query(f"SELECT doc_id, sha256(array_to_string(ts, chr(10))) AS digest, CAST(len(ts) AS INTEGER) AS n FROM ({DOC_TOKENS})")
def tokenize(spark, sf_dir):
    return _tokens(spark, sf_dir).select("doc_id", F.sha2(F.array_join("tokens", "\n"), 256).alias("digest"), F.size("tokens").alias("n"))


@_query(f"SELECT doc_id, CAST(len(ts) AS INTEGER) AS n FROM ({DOC_TOKENS})")
def token_count(spark, sf_dir):
    return _tokens(spark, sf_dir).select("doc_id", F.size("tokens").alias("n"))


@_query(f"SELECT token, count(*) AS n FROM (SELECT unnest({S.keys('ts')}) AS token FROM ({DOC_TOKENS})) GROUP BY token")
def token_freq(spark, sf_dir):
    return _keys(spark, sf_dir).select(F.explode("keys").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@_query(f"SELECT doc_id, sha256(array_to_string({S.keys('ts')}, ' ')) AS digest FROM ({DOC_TOKENS})")
def normalized_tokens(spark, sf_dir):
    return _tokens(spark, sf_dir).select("doc_id", F.sha2(F.array_join(T.normalize(F.col("tokens")), " "), 256).alias("digest"))


@_query(f"SELECT doc_id, {S.joined('ts', '2', '7')} AS some, sha256({S.joined('ts', '0', 'len(ts)')}) AS whole FROM ({DOC_TOKENS})")
def join_tokens(spark, sf_dir):
    """Six tokens, and all of them."""
    some, whole = T.join_tokens(F.col("tokens"), F.lit(2), F.lit(7)), T.join_tokens(F.col("tokens"), F.lit(0), F.size("tokens"))
    return _tokens(spark, sf_dir).select("doc_id", some.alias("some"), F.sha2(whole, 256).alias("whole"))


SENTENCES = [("One. Two.", "One. ¶ Two."), ("Only one", "Only one"), ("Is it? Yes!", "Is it? ¶ Yes!"), ("See Dr. Smith. He left.", "See Dr. Smith. ¶ He left."), ("", "")]


@_query("SELECT * FROM (VALUES " + ", ".join(f"({S.quoted(a)}, {S.quoted(b)})" for a, b in SENTENCES) + ") v(text, marked)")
def sentence_mark(spark, sf_dir):
    from emendra.functions.sql import mark_sentences

    return spark.createDataFrame([(a,) for a, _ in SENTENCES], "text string").select("text", mark_sentences()("text").alias("marked"))


# --- differences


@_query(f"{OPS} SELECT id, n, tag, i1, i2, j1, j2 FROM ops")
def diff_ops_alone(spark, sf_dir):
    """Operations without tokens."""
    found = D.pair_ops(turn_pairs(spark, sf_dir)).select("id", F.posexplode("ops").alias("n", "op"))
    return found.select("id", (F.col("n") + 1).alias("n"), "op.tag", "op.i1", "op.i2", "op.j1", "op.j2")


#: Sentences as a splitter that SQL can say too finds them: cut after each stop with a blank behind.
MARKED_TURNS = f"SELECT id, regexp_replace(source, '([.!?]) ', '\\1 ¶ ', 'g') AS source, regexp_replace(test, '([.!?]) ', '\\1 ¶ ', 'g') AS test FROM (SELECT id, {S.strip(S.one_line('source'))} AS source, {S.strip(S.one_line('test'))} AS test FROM ({TURNS}))"


def _after_stops(text: str) -> list[str]:
    import re

    return re.split(r"(?<=[.!?]) ", text)


@_query(f"WITH RECURSIVE {S.operations(MARKED_TURNS)} SELECT id, n, tag, i1, i2, j1, j2 FROM ops")
def diff_sentences(spark, sf_dir):
    """Turns on one line each, compared by sentences that a custom splitter finds."""
    line = lambda c: T.strip(F.regexp_replace(c, rf"[{T.SPACE}]+", " ")).alias(c)
    pairs = turn_pairs(spark, sf_dir).select("id", line("source"), line("test"))
    found = D.diff_pairs(pairs, D.by_sentence(_after_stops)).select("id", F.posexplode("ops").alias("n", "op"))
    return found.select("id", (F.col("n") + 1).alias("n"), "op.tag", "op.i1", "op.i2", "op.j1", "op.j2")


@_query(f"{OPS} SELECT id, n, tag, i1, i2, j1, j2 FROM ops")
def diff_ops_sql(spark, sf_dir):
    """By the SQL function."""
    from emendra.functions.sql import register

    register(spark)
    found = turn_pairs(spark, sf_dir).selectExpr("id", "diff_ops(source, test) AS d").select("id", F.posexplode("d.ops").alias("n", "op"))
    return found.select("id", (F.col("n") + 1).alias("n"), "op.tag", "op.i1", "op.i2", "op.j1", "op.j2")


@_query(f"{OPS_TEXTS} SELECT id, tag AS operation, CASE WHEN tag <> 'insert' THEN s END AS source_text, CASE WHEN tag <> 'delete' THEN t END AS test_text FROM texts WHERE tag <> 'equal'")
def text_changes_sql(spark, sf_dir):
    """By the table function."""
    from emendra.functions.sql import register

    register(spark)
    return spark.sql("SELECT id, c.operation, c.source_text, c.test_text FROM {pairs}, LATERAL text_changes(source, test) c", pairs=turn_pairs(spark, sf_dir))


@_query(f"{OPS} SELECT id, n, tag, i1, i2, j1, j2 FROM ops")
def diff_opcodes(spark, sf_dir):
    found = _turn_diffs(spark, sf_dir).select("id", F.posexplode("ops").alias("n", "op"))
    return found.select("id", (F.col("n") + 1).alias("n"), "op.tag", "op.i1", "op.i2", "op.j1", "op.j2")


FIRST_ITEM = "SELECT CAST(t.item_id AS BIGINT) AS id, s.text AS source, t.text AS test FROM benchmark t, (SELECT text FROM benchmark WHERE item_id = 0) s"


@_query(f"WITH RECURSIVE {S.operations(FIRST_ITEM)}, {S.TEXTS}, {S.STATS} SELECT id, total_changes, chars_added, chars_deleted FROM stats")
def compare_many(spark, sf_dir):
    items = _table(spark, sf_dir, "benchmark")
    pairs = P.compare_many(items.where("item_id = 0").select(F.col("text").alias("source")), items.select(F.col("item_id").cast("long").alias("id"), F.col("text").alias("test")))
    found = C.with_changes(D.diff_pairs(pairs)).select("id", C.stats().alias("s"))
    return found.select("id", "s.total_changes", "s.chars_added", "s.chars_deleted")


# unique tokens, planted edits: the expected operations need no matcher, whatever the length of the text
PLANTED = f"""
    w AS MATERIALIZED (SELECT doc_id, i, k, CASE WHEN i % 11 = 3 THEN 'd' WHEN i % 7 = 2 THEN 'r' ELSE 'e' END AS kind, i % 13 = 5 AS more FROM (
        SELECT doc_id, generate_subscripts(ks, 1) - 1 AS i, unnest(ks) AS k FROM (SELECT doc_id, list_transform({S.keys('ts')}, lambda x: replace(replace(x, '(', ''), ')', '')) AS ks FROM ({DOC_TOKENS})))),
    u AS MATERIALIZED (SELECT *, kind = 'e' AND step = 0 AS same, sum(CASE WHEN step = 0 THEN 1 ELSE 0 END) OVER o - CASE WHEN step = 0 THEN 1 ELSE 0 END AS si, sum(CASE WHEN step = 1 OR kind <> 'd' THEN 1 ELSE 0 END) OVER o - CASE WHEN step = 1 OR kind <> 'd' THEN 1 ELSE 0 END AS tj FROM (
        SELECT doc_id, i, kind, 0 AS step, length(i || '_' || k) AS sl, CASE kind WHEN 'd' THEN 0 WHEN 'r' THEN length('new' || i) ELSE length(i || '_' || k) END AS tl FROM w
        UNION ALL SELECT doc_id, i, kind, 1, 0, length('ins' || i) FROM w WHERE more) WINDOW o AS (PARTITION BY doc_id ORDER BY i, step)),
    g AS (SELECT *, sum(turns) OVER (PARTITION BY doc_id ORDER BY i, step) AS island FROM (SELECT *, CASE WHEN same = lag(same) OVER (PARTITION BY doc_id ORDER BY i, step) THEN 0 ELSE 1 END AS turns FROM u)),
    po AS MATERIALIZED (SELECT doc_id, CASE WHEN bool_and(same) THEN 'equal' WHEN bool_or(step = 0) AND bool_or(step = 1 OR kind <> 'd') THEN 'replace' WHEN bool_or(step = 0) THEN 'delete' ELSE 'insert' END AS tag,
        CAST(min(si) AS INTEGER) AS i1, CAST(min(si) + count(*) FILTER (step = 0) AS INTEGER) AS i2, CAST(min(tj) AS INTEGER) AS j1, CAST(min(tj) + count(*) FILTER (step = 1 OR kind <> 'd') AS INTEGER) AS j2,
        sum(sl) + count(*) FILTER (step = 0) AS sl, sum(tl) + count(*) FILTER (step = 1 OR kind <> 'd') AS tl FROM g GROUP BY doc_id, island)"""


def planted_pairs(spark, sf_dir):
    """Documents with tokens made unique by their place, and an edited copy; joined by blanks."""
    keys = F.transform("keys", lambda x: F.replace(F.replace(x, F.lit("("), F.lit("")), F.lit(")"), F.lit("")))

    def edited(k, i):
        place = i.cast("string")
        kept = F.when(i % 11 == 3, F.array().cast("array<string>")).when(i % 7 == 2, F.array(F.concat(F.lit("new"), place))).otherwise(F.array(F.concat(place, F.lit("_"), k)))
        return F.concat(kept, F.when(i % 13 == 5, F.array(F.concat(F.lit("ins"), place))).otherwise(F.array().cast("array<string>")))

    rows = _keys(spark, sf_dir).select("doc_id", keys.alias("keys"))
    return rows.select("doc_id", F.array_join(F.transform("keys", lambda k, i: F.concat(i.cast("string"), F.lit("_"), k)), " ").alias("source"), F.array_join(F.flatten(F.transform("keys", edited)), " ").alias("test")).repartition("doc_id")


@_query(f"WITH {PLANTED} SELECT doc_id, tag, i1, i2, j1, j2 FROM po")
def diff_opcodes_planted(spark, sf_dir):
    return D.pair_ops(planted_pairs(spark, sf_dir)).select("doc_id", F.inline("ops"))


@_query(f"""WITH {PLANTED} SELECT d.doc_id, CAST(count(tag) FILTER (tag <> 'equal') AS INTEGER) AS total_changes, CAST(count(*) FILTER (tag = 'delete') AS INTEGER) AS deletions,
        CAST(count(*) FILTER (tag = 'insert') AS INTEGER) AS insertions, CAST(count(*) FILTER (tag = 'replace') AS INTEGER) AS replacements FROM documents d LEFT JOIN po ON po.doc_id = d.doc_id GROUP BY d.doc_id""")
def pair_stats_planted(spark, sf_dir):
    found = C.with_changes(D.diff_pairs(planted_pairs(spark, sf_dir))).select("doc_id", C.stats().alias("s"))
    return found.select("doc_id", "s.total_changes", "s.deletions", "s.insertions", "s.replacements")


# --- changes and statistics

CHANGE_SQL = "SELECT id, tag AS operation, CASE WHEN tag <> 'insert' THEN s END AS source_text, CASE WHEN tag <> 'delete' THEN t END AS test_text, CASE WHEN tag <> 'insert' THEN i1 ELSE -1 END AS source_start, CASE WHEN tag <> 'insert' THEN i2 ELSE -1 END AS source_end, CASE WHEN tag <> 'delete' THEN j1 ELSE -1 END AS test_start, CASE WHEN tag <> 'delete' THEN j2 ELSE -1 END AS test_end FROM texts WHERE tag <> 'equal'"


def _changes(spark, sf_dir, operation=None):
    """One row per change; positions of a side that it lacks are -1."""
    found = C.with_changes(_turn_diffs(spark, sf_dir)).select("id", F.explode(C.of_operation("changes", operation)).alias("c"))
    at = [F.coalesce(f"c.{side}_position.{end}", F.lit(-1)).alias(f"{side}_{end}") for side in ("source", "test") for end in ("start", "end")]
    return found.select("id", "c.operation", "c.source_text", "c.test_text", *at)


@_query(f"{OPS_TEXTS} {CHANGE_SQL}")
def changes(spark, sf_dir):
    return _changes(spark, sf_dir)


@_query(f"{OPS_TEXTS} {CHANGE_SQL} AND tag = 'delete'")
def changes_delete(spark, sf_dir):
    return _changes(spark, sf_dir, "delete")


@_query(f"{OPS_TEXTS} {CHANGE_SQL} AND tag = 'insert'")
def changes_insert(spark, sf_dir):
    return _changes(spark, sf_dir, "insert")


@_query(f"{OPS_TEXTS} {CHANGE_SQL} AND tag = 'replace'")
def changes_replace(spark, sf_dir):
    return _changes(spark, sf_dir, "replace")


@_query(f"{OPS_STATS} SELECT id, {S.STATS_COLUMNS} FROM stats")
def pair_stats(spark, sf_dir):
    return _turn_stats(spark, sf_dir).select("id", "stats.*").drop("levenshtein_distance")


@_query("SELECT conv_id, turn, 0 AS total_changes, CAST(0 AS DOUBLE) AS change_ratio, 0 AS levenshtein_distance FROM conversations")
def stats_identical(spark, sf_dir):
    same = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("source"), F.col("text").alias("test"))
    found = C.with_changes(D.diff_pairs(same)).select("conv_id", "turn", C.stats(levenshtein=True).alias("s"))
    return found.select("conv_id", "turn", "s.total_changes", "s.change_ratio", "s.levenshtein_distance")


@_query("""SELECT a.item_id, CAST(levenshtein(a.text, b.text) AS INTEGER) AS distance FROM
        (SELECT item_id, regexp_replace(text, '[^\\x00-\\x7f]', '?', 'g') AS text FROM benchmark) a JOIN (SELECT item_id, regexp_replace(text, '[^\\x00-\\x7f]', '?', 'g') AS text FROM benchmark) b ON b.item_id = a.item_id + 1""")
def levenshtein_ascii(spark, sf_dir):
    """Other characters become "?" first, as the SQL engine counts bytes."""
    items = _table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", r"[^\x00-\x7f]", "?").alias("text"))
    other = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("test"))
    pairs = items.withColumnRenamed("text", "source").join(other, "item_id").withColumn("changes", F.array().cast("array<struct<operation: string, source_text: string, test_text: string>>"))
    return pairs.select("item_id", C.stats(levenshtein=True)["levenshtein_distance"].alias("distance"))


@_query(f"{OPS_STATS} SELECT id FROM stats WHERE total_changes > 0")
def changed_pairs(spark, sf_dir):
    return _turn_stats(spark, sf_dir).where("stats.total_changes > 0").select("id")


@_query(f"{OPS_STATS} SELECT id, total_changes FROM stats ORDER BY total_changes DESC, id LIMIT 10")
def top_changed(spark, sf_dir):
    return _turn_stats(spark, sf_dir).select("id", "stats.total_changes").orderBy(F.desc("total_changes"), "id").limit(10)


@_query(f"{OPS} SELECT tag AS operation, count(*) AS n FROM ops WHERE tag <> 'equal' GROUP BY tag")
def changes_by_operation(spark, sf_dir):
    return P.by_operation(C.with_changes(_turn_diffs(spark, sf_dir)))


@_query(f"{OPS_STATS} SELECT coalesce(role, '(all)') AS role, CAST(coalesce(turn, -1) AS BIGINT) AS turn, count(*) AS pairs, CAST(sum(total_changes) AS BIGINT) AS changes FROM stats JOIN conversations ON id = conv_id || '/' || turn GROUP BY ROLLUP (role, turn)")
def stats_rollup(spark, sf_dir):
    roles = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    found = _turn_stats(spark, sf_dir).select("conv_id", "turn", "stats.total_changes").join(roles, ["conv_id", "turn"])
    rolled = found.rollup("role", "turn").agg(F.count(F.lit(1)).alias("pairs"), F.sum("total_changes").alias("changes"))
    return rolled.select(F.coalesce("role", F.lit("(all)")).alias("role"), F.coalesce(F.col("turn").cast("long"), F.lit(-1).cast("long")).alias("turn"), "pairs", "changes")


# --- pairing


def _questions_and_answers(spark, sf_dir):
    """User turns by place, and assistant turns by the place of the turn before."""
    turns = _table(spark, sf_dir, "conversations")
    key = lambda shift: F.concat_ws("/", F.col("conv_id").cast("string"), (F.col("turn") - shift).cast("string")).alias("key")
    return turns.where("role = 'user'").select(key(0), "text"), turns.where("role = 'assistant'").select(key(1), "text")


OLD = "SELECT conv_id || '/' || turn AS key, text FROM conversations WHERE role = 'user'"
NEW = "SELECT conv_id || '/' || (turn - 1) AS key, text FROM conversations WHERE role = 'assistant'"
QA = f"SELECT o.key AS id, o.text AS source, n.text AS test FROM ({OLD}) o JOIN ({NEW}) n USING (key)"
STATUS = f"SELECT key, o.text AS source, n.text AS test, CASE WHEN n.text IS NULL THEN 'deleted' WHEN o.text IS NULL THEN 'new' ELSE 'modified' END AS status FROM ({OLD}) o FULL JOIN ({NEW}) n USING (key)"


@_query(f"WITH RECURSIVE {S.operations(QA)}, {S.TEXTS}, {S.STATS} SELECT id AS key, total_changes FROM stats")
def pair_by_key(spark, sf_dir):
    pairs = P.pair_by_key(*_questions_and_answers(spark, sf_dir))
    return C.with_changes(D.diff_pairs(pairs)).select("key", F.size("changes").alias("total_changes"))


@_query(f"SELECT key, CASE WHEN n.text IS NULL THEN 'missing_in_dir2' ELSE 'compared' END AS status FROM ({OLD}) o LEFT JOIN ({NEW}) n USING (key)")
def batch_status(spark, sf_dir):
    return P.left_status(*_questions_and_answers(spark, sf_dir)).select("key", "status")


@_query(f"SELECT key, status FROM ({STATUS})")
def snapshot_status(spark, sf_dir):
    return P.snapshot_status(*_questions_and_answers(spark, sf_dir)).select("key", "status")


@_query(f"SELECT status, count(*) AS n FROM ({STATUS}) GROUP BY status")
def status_counts(spark, sf_dir):
    return P.by_status(P.snapshot_status(*_questions_and_answers(spark, sf_dir)))


@_query(f"SELECT key FROM ({OLD}) WHERE key NOT IN (SELECT key FROM ({NEW}))")
def missing_keys(spark, sf_dir):
    return P.missing_keys(*_questions_and_answers(spark, sf_dir))


@_query(f"SELECT key FROM ({OLD}) WHERE key IN (SELECT key FROM ({NEW}))")
def paired_keys(spark, sf_dir):
    return P.paired_keys(*_questions_and_answers(spark, sf_dir))


def _with_changes_count(rows):
    return C.with_changes(D.diff_pairs(rows)).withColumn("changes", F.size("changes"))


@_query(f"WITH RECURSIVE {S.operations(QA)}, {S.TEXTS}, {S.STATS}, rows AS (SELECT key, total_changes AS changes FROM ({OLD}) LEFT JOIN stats ON key = id) SELECT count(*) AS total_files, count(changes) AS compared, count(*) FILTER (changes > 0) AS with_changes, CAST(0 AS BIGINT) AS errors, count(*) - count(changes) AS missing FROM rows")
def batch_summary(spark, sf_dir):
    rows = _with_changes_count(P.left_status(*_questions_and_answers(spark, sf_dir)))
    return P.batch_summary(rows.withColumn("changes", F.when(F.col("status") == "compared", F.col("changes"))))


@_query(f"{OPS_STATS} SELECT CAST(sum(total_changes) AS BIGINT) AS total_changes, count(*) FILTER (total_changes > 0) AS files_with_changes, round(avg(change_ratio), 9) AS mean_change_ratio FROM stats")
def report_summary(spark, sf_dir):
    return P.report_summary(_turn_stats(spark, sf_dir)).withColumn("mean_change_ratio", F.round("mean_change_ratio", 9))


@_query(f"""WITH RECURSIVE {S.operations(QA)}, {S.TEXTS}, {S.STATS}, rows AS (SELECT key, status, coalesce(total_changes, 0) AS changes FROM ({STATUS}) LEFT JOIN stats ON key = id)
        SELECT count(*) AS total_files, count(*) FILTER (status <> 'modified' OR changes > 0) AS files_with_changes, CAST(sum(changes) AS BIGINT) AS total_changes FROM rows""")
def ci_summary(spark, sf_dir):
    rows = _with_changes_count(P.snapshot_status(*_questions_and_answers(spark, sf_dir)))
    return P.ci_summary(rows.withColumn("changes", F.when(F.col("status") == "modified", F.col("changes"))))


# --- versions: the turns of a conversation as versions of a document

VERSIONS = f"{OPS_STATS}, v AS (SELECT conv_id AS doc, turn AS version, coalesce(total_changes, 0) AS total_changes, coalesce(change_ratio, 0.0) AS change_ratio FROM conversations LEFT JOIN stats ON id = conv_id || '/' || (turn - 1) AND turn > 0)"


def _versions(spark, sf_dir):
    return P.version_stats(_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("version"), "text"))


@_query(f"{VERSIONS} SELECT doc, version, total_changes, change_ratio FROM v")
def version_diff(spark, sf_dir):
    return _versions(spark, sf_dir).drop("cumulative_changes")


@_query(f"{VERSIONS} SELECT doc, version, CAST(sum(total_changes) OVER (PARTITION BY doc ORDER BY version ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative_changes FROM v")
def version_running_total(spark, sf_dir):
    return _versions(spark, sf_dir).select("doc", "version", "cumulative_changes")


# --- renderings


def _markdown(style, markup):
    def query(spark, sf_dir):
        return _turn_diffs(spark, sf_dir).select("id", R.markdown(style, **({"ins_class": "added", "del_class": "gone"} if style == "custom_css" else {})).alias("markdown"))

    query.__name__ = f"markdown_{'css' if style == 'custom_css' else style}"
    _query(f"{OPS_TEXTS} SELECT id, string_agg(shown, '' ORDER BY n) AS markdown FROM (SELECT id, n, {S.rendered(*markup)} AS shown FROM texts) GROUP BY id")(query)


for _style in ("none", "red_green", "red", "ghfm", "bbcode", "streamlit", "custom_css"):
    _markdown(_style, R.markup_of(_style, "added", "gone"))

SPAN_SQL = f"""SELECT id, text, style, n, CAST(k AS INTEGER) AS k FROM (
    SELECT id, n, 1 AS k, {S.unmark('s')} AS text, CAST(NULL AS VARCHAR) AS style FROM texts WHERE tag = 'equal'
    UNION ALL SELECT id, n, 1, s, 'strike red' FROM texts WHERE tag IN ('delete', 'replace')
    UNION ALL SELECT id, n, 1 + generate_subscripts(string_split(t, '¶ '), 1), unnest(string_split(t, '¶ ')), 'green' FROM texts WHERE tag IN ('insert', 'replace')) WHERE text <> ''"""


@_query(f"{OPS_TEXTS} SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY n, k) AS INTEGER) AS pos, text, style FROM ({SPAN_SQL})")
def rich_spans(spark, sf_dir):
    found = _turn_diffs(spark, sf_dir).select("id", F.posexplode(R.spans()).alias("pos", "span"))
    return found.select("id", (F.col("pos") + 1).alias("pos"), "span.text", "span.style")


UNMARKED = f"u AS (SELECT *, {S.unmark('s')} AS us, {S.unmark('t')} AS ut FROM texts)"
PLACED = """placed AS (SELECT *, CAST(coalesce(sum(length(us)) OVER b, 0) AS INTEGER) AS s0, CAST(coalesce(sum(length(ut)) OVER b, 0) AS INTEGER) AS t0 FROM u WINDOW b AS (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
SHOWN = "CASE WHEN tag <> 'insert' THEN {} ELSE -1 END", "CASE WHEN tag <> 'delete' THEN {} ELSE -1 END"


@_query(f"{OPS_TEXTS}, {UNMARKED}, {PLACED} SELECT id, n, {SHOWN[0].format('s0')} AS source_start, {SHOWN[0].format('CAST(s0 + length(us) AS INTEGER)')} AS source_end, {SHOWN[1].format('t0')} AS test_start, {SHOWN[1].format('CAST(t0 + length(ut) AS INTEGER)')} AS test_end FROM placed")
def char_positions(spark, sf_dir):
    found = _turn_diffs(spark, sf_dir).select("id", F.posexplode(R.json_changes()).alias("n", "c"))
    at = [F.coalesce(F.element_at(f"c.{side}_position", k), F.lit(-1)).alias(f"{side}_{end}") for side in ("source", "test") for k, end in ((1, "start"), (2, "end"))]
    return found.select("id", (F.col("n") + 1).alias("n"), *at)


def _json(spark, sf_dir):
    return R.with_json(_turn_diffs(spark, sf_dir)).select("id", F.from_json("json", R.JSON_SCHEMA).alias("j"))


@_query(f"""{OPS_TEXTS}, {UNMARKED} SELECT id, n, tag AS type, CASE tag WHEN 'insert' THEN ut WHEN 'replace' THEN NULL ELSE us END AS text, CASE tag WHEN 'replace' THEN us END AS source_text, CASE tag WHEN 'replace' THEN ut END AS test_text,
        {SHOWN[0].format('i1')} AS source_token_start, {SHOWN[1].format('j2')} AS test_token_end FROM u""")
def json_changes(spark, sf_dir):
    found = _json(spark, sf_dir).select("id", F.posexplode("j.changes").alias("n", "c"))
    return found.select("id", (F.col("n") + 1).alias("n"), "c.type", "c.text", "c.source_text", "c.test_text", F.coalesce(F.element_at("c.source_token_position", 1), F.lit(-1)).alias("source_token_start"), F.coalesce(F.element_at("c.test_token_position", 2), F.lit(-1)).alias("test_token_end"))


@_query(f"{OPS_STATS} SELECT stats.id, {S.STATS_COLUMNS}, (SELECT CAST(count(*) AS INTEGER) FROM ops WHERE ops.id = stats.id AND tag = 'equal') AS unchanged FROM stats")
def json_stats(spark, sf_dir):
    return _json(spark, sf_dir).select("id", "j.stats.*").drop("levenshtein_distance")


STATS_TEXT = "'Total Changes: ' || total_changes || chr(10) || 'Deletions: ' || deletions || chr(10) || 'Insertions: ' || insertions || chr(10) || 'Replacements: ' || replacements || chr(10) || 'Characters Added: ' || chars_added || chr(10) || 'Characters Deleted: ' || chars_deleted || chr(10) || 'Net Change: ' || chars_net_change || chr(10) || 'Change Ratio: ' || printf('%.1f%%', change_ratio * 100)"


@_query(f"{OPS_STATS} SELECT id, {STATS_TEXT} AS text FROM stats")
def stats_text(spark, sf_dir):
    return _turn_stats(spark, sf_dir).select("id", R.stats_text().alias("text"))


FIGURE = "'<dt>{}</dt><dd>' || {} || '</dd>'"
PER_MILLE = "CAST(floor(change_ratio * 1000) AS BIGINT)"
SECTION = " || ".join(FIGURE.format(*x) for x in (("edits", "total_changes"), ("taken out", "deletions"), ("put in", "insertions"), ("swapped", "replacements"), ("longer by", "chars_net_change"), ("per mille touched", PER_MILLE)))


@_query(f"""{OPS_STATS}, md AS (SELECT id, string_agg(shown, '' ORDER BY n) AS markdown FROM (SELECT id, n, {S.rendered(*R.MARKUP['none'])} AS shown FROM texts) GROUP BY id)
        SELECT id, '<section class="' || CASE WHEN total_changes = 0 THEN 'same' ELSE 'edited' END || '"><h2>' || id || '</h2><dl>' || {SECTION} || '</dl>'
        || CASE WHEN total_changes = 0 THEN '<p>Nothing differs.</p>' ELSE '<blockquote>' || markdown || '</blockquote>' END || '</section>' AS section FROM stats JOIN md USING (id)""")
def html_section(spark, sf_dir):
    found = _turn_stats(spark, sf_dir).withColumn("markdown", R.markdown("none")).withColumn("path", F.col("id"))
    return found.select("id", R.html_section().alias("section"))


@_query(f"""{OPS_STATS} SELECT id, concat('| ', total_changes, ' | ', {PER_MILLE}, ' | ', deletions, ' | ', insertions, ' | ', replacements, ' | ', id, ' |') AS line FROM stats WHERE total_changes > 0""")
def ci_lines(spark, sf_dir):
    return _turn_stats(spark, sf_dir).where("stats.total_changes > 0").select("id", P.ci_line("id").alias("line"))


PANEL = " || chr(10) || ".join(f"'│ ' || rpad('{name}', 22, ' ') || rpad(CAST({value} AS VARCHAR), 14, ' ') || ' │'" for name, value in (("Total Changes", "total_changes"), ("Deletions", "deletions"), ("Insertions", "insertions"), ("Replacements", "replacements"), ("Characters Added", "'+' || chars_added"), ("Characters Deleted", "'-' || chars_deleted"), ("Net Change", "chars_net_change"), ("Change Ratio", "printf('%.1f%%', change_ratio * 100)")))


@_query(f"{OPS_STATS} SELECT id, '╭─ Statistics ' || repeat('─', 25) || '╮' || chr(10) || {PANEL} || chr(10) || '╰' || repeat('─', 38) || '╯' AS panel FROM stats")
def stats_panel(spark, sf_dir):
    return _turn_stats(spark, sf_dir).select("id", R.stats_panel().alias("panel"))


ANSI_OF = "CASE style " + " ".join(f"WHEN '{k}' THEN {S.quoted(v)}" for k, v in R.ANSI.items()) + " END"


@_query(f"{OPS_TEXTS} SELECT id, string_agg(CASE WHEN style IS NULL THEN text ELSE {ANSI_OF} || text || chr(27) || '[0m' END, '' ORDER BY n, k) AS shown FROM ({SPAN_SQL}) GROUP BY id")
def ansi_spans(spark, sf_dir):
    return _turn_diffs(spark, sf_dir).select("id", R.ansi(R.spans()).alias("shown")).where("shown != ''")
