"""Golden pairs, invariants and the matcher, through the DataFrame operators."""

import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from emendra.facade import TextDiff
from emendra.functions import changes as C
from emendra.functions import render as R
from emendra.functions import text as T
from emendra.operators import diff as D

# fixed expectations: these pairs' markup and figures are what any implementation must give
FOX = "The quick brown fox jumps over the lazy dog."
NO_LAZY = "The quick brown fox jumps over the dog."
WALKS = "The quick brown fox walks past the lazy dog."
SPACES = [c for c in map(chr, range(0x110000)) if c.isspace()]


def run(spark, pairs, processor=None):
    frame = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "id int, source string, test string")
    found = C.with_changes(D.diff_pairs(frame, processor)).withColumn("stats", C.stats())
    return {r.id: r for r in R.with_json(found).withColumn("markdown", R.markdown("none")).withColumn("spans", R.spans()).collect()}


ODD = [f"a{c}b{c}{c}(c)" for c in SPACES] + ["((a))", "(see Fig. 2)?", "yes!-no well-known", "x ¶ y", "a\r\nb\r\n\r\nc", "\n \n", " \t", "¶ ", "a\n\n \n b", "", "e) . f"]


def test_native_tokens_equal_plain_ones(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "id int, t string")
    found = rows.select("id", T.paragraphs(F.col("t")).alias("p"), T.mark_paragraphs(F.col("t")).alias("m")).withColumn("k", T.tokenize(F.col("m"))).withColumn("n", T.normalize(F.col("k")))
    for r in found.collect():
        text = ODD[r.id]
        assert r.p == T.plain_paragraphs(text) and r.m == T.plain_mark_paragraphs(text)
        assert r.k == T.plain_tokenize(r.m) and r.n == [x.strip() for x in r.k]


def random_text(rng, n):
    return "".join(rng.choice(["the", "cat", "dog", "a", "b", "c.", "(x)", "fox"]) + rng.choice([" ", " ", "  ", "\n", "\n\n", " ¶ "]) for _ in range(n))


def test_invariants_and_matcher(spark):
    rng = random.Random(4)
    pairs = [(random_text(rng, rng.randrange(60)), random_text(rng, rng.randrange(60))) for _ in range(80)]
    pairs += [(random_text(rng, 300), random_text(rng, 199)), (random_text(rng, 150), random_text(rng, 320)), (FOX, FOX), ("", ""), ("  ", "  "), ("", "x"), ("y", "")]
    pairs += [(a, a) for a in ODD]
    for k, r in run(spark, pairs).items():
        source, test = pairs[k]
        a, b = T.plain_tokenize(T.plain_mark_paragraphs(source)), T.plain_tokenize(T.plain_mark_paragraphs(test))
        want = difflib.SequenceMatcher(None, [x.strip() for x in a], [x.strip() for x in b]).get_opcodes()
        assert [tuple(op) for op in r.ops] == want and (r.source_tokens, r.test_tokens) == (a, b)
        s = r.stats
        assert s.deletions + s.insertions + s.replacements == s.total_changes == len(r.changes) == sum(op[0] != "equal" for op in want) * (source != test)
        assert s.chars_net_change == s.chars_added - s.chars_deleted
        whole = json.loads(r.json)
        assert json.dumps(whole, ensure_ascii=False) == r.json
        for side, tokens in (("source", a), ("test", b)):
            at = 0
            for c in whole["changes"]:
                if c[f"{side}_position"]:
                    assert c[f"{side}_position"][0] == at
                    at = c[f"{side}_position"][1]
            assert at == sum(len("".join(tokens[i:j]).replace("¶ ", "\n\n")) for i, j in ((op[1], op[2]) if side == "source" else (op[3], op[4]) for op in want))
        assert s.levenshtein_distance is None


@pytest.mark.parametrize(
    "source,test,markdown",
    [
        (NO_LAZY, FOX, "The quick brown fox jumps over the <ins>lazy </ins>dog."),
        (FOX, NO_LAZY, "The quick brown fox jumps over the <del>lazy </del>dog."),
        (FOX, WALKS, "The quick brown fox <del>jumps over </del><ins>walks past </ins>the lazy dog."),
        ("Hello\n\nWorld", "Hello\n\nEarth", "Hello \n\n<del>World</del><ins>Earth</ins>"),
        ("Rain fell.\n\nSoon,\nsnow", "Rain fell.\n\nsleet.", "Rain fell. \n\n<del>Soon, ¶ snow</del><ins>sleet.</ins>"),
        ("a", "a\nb\nc", "a<ins>\n\n</ins>".replace("<ins>\n\n</ins>", "<ins></ins>\n\n<ins>b </ins>\n\n<ins>c</ins>")),
    ],
)
def test_golden_markdown(spark, source, test, markdown):
    assert run(spark, [(source, test)])[0].markdown == markdown


def test_styles(spark):
    own = TextDiff(FOX, spark=spark)
    found = {s: own.compare(WALKS, markdown_style=s) for s in ("red_green", "red", "none", None, "ghfm", "bbcode", "streamlit", "custom_css", "unheard-of")}
    assert found["unheard-of"] == found["red_green"] and found[None] == found["none"]
    assert found["ghfm"] == "The quick brown fox ~~jumps over ~~**walks past **the lazy dog."
    assert found["bbcode"] == "The quick brown fox [s][color=red]jumps over [/color][/s][b][color=green]walks past [/color][/b]the lazy dog."
    assert found["streamlit"] == "The quick brown fox ~~:red[jumps over ]~~ **:green[walks past ]** the lazy dog."
    assert found["custom_css"] == "The quick brown fox <span class='redline-deleted'>jumps over </span><span class='redline-inserted'>walks past </span>the lazy dog."
    assert "text-decoration:line-through" in found["red"]
    assert "<span class='i'>" in own.compare(WALKS, markdown_style="custom_css", ins_class="i")


def test_golden_statistics(spark):
    rows = run(spark, [(FOX, WALKS), ("Hello world", "Hello beautiful world"), ("A B C D E", "A X C E F"), ("a\nb", ""), ("a b", "a  b")])
    s = rows[0].stats
    assert (s.replacements, s.longest_change_length, s.shortest_change_length, s.average_change_length, s.chars_added, s.chars_deleted) == (1, 11, 11, 11.0, 11, 11)
    assert s.change_ratio == 11 / 44
    assert rows[0].changes[0].source_position.asDict() == {"start": 4, "end": 6}
    s = rows[1].stats
    assert (s.insertions, s.chars_net_change, s.change_ratio) == (1, 10, 10 / 21)
    assert rows[1].changes[0].source_text is None and rows[1].changes[0].source_position is None
    s = rows[2].stats
    assert (s.total_changes, s.longest_change_length, s.shortest_change_length, s.average_change_length, s.chars_added, s.chars_deleted) == (3, 2, 1, 5 / 3, 3, 4)
    assert rows[3].stats.change_ratio == 5 / 3
    assert rows[4].stats.total_changes == 0
    assert rows[4].ops[0].tag == "equal"


def test_operations_alone_equal_those_with_tokens(spark):
    rng = random.Random(14)
    pairs = [(random_text(rng, rng.randrange(40)), random_text(rng, rng.randrange(40))) for _ in range(60)] + [(x, x) for x in ODD] + list(zip(ODD, ODD[1:])) + [(None, "a"), ("a", None), (None, None)]
    frame = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "id int, source string, test string")
    want = {r.id: r.ops for r in D.diff_pairs(frame).collect()}
    assert {r.id: r.ops for r in D.pair_ops(frame).collect()} == want
    keys = frame.select("id", T.keys(F.col("source")).alias("k"), T.normalize(T.tokenize(F.col("source"))).alias("n")).collect()
    assert all(r.k == r.n for r in keys)


def test_json_is_checked_by_kind(spark):
    good = [r.json for r in run(spark, [(FOX, WALKS), (FOX, FOX), ("a b", ""), ("", "x"), ("A B C D E", "A X C E F")]).values()]

    def broken(edit):
        whole = json.loads(good[4])
        edit(whole)
        return json.dumps(whole)

    kinds = [c["type"] for c in json.loads(good[4])["changes"]]
    bad = [
        "{",
        broken(lambda w: w["changes"][0].update(type="move")),
        broken(lambda w: w["changes"][kinds.index("equal")].update(test_position=None)),
        broken(lambda w: w["changes"][kinds.index("delete")].update(test_position=[1, 2])),
        broken(lambda w: w["changes"][kinds.index("replace")].update(text="x")),
        broken(lambda w: w["stats"].update(insertions=9)),
        broken(lambda w: w["stats"].update(chars_net_change=99)),
    ]
    rows = spark.createDataFrame(list(enumerate(good + bad)), "id int, json string").select("id", R.json_problems().alias("p")).orderBy("id").collect()
    assert [r.p for r in rows[: len(good)]] == [[]] * len(good)
    assert all(r.p for r in rows[len(good) :]) and rows[len(good)].p == ["not readable"]


def test_nulls_and_repeated_pairs(spark):
    frame = spark.createDataFrame([(1, None, "a"), (2, "a", None), (3, FOX, WALKS), (4, FOX, WALKS), (5, None, None)], "id int, source string, test string")
    found = {r.id: r for r in C.with_changes(D.diff_distinct(frame)).withColumn("stats", C.stats()).collect()}
    assert found[1].ops is None and found[2].stats is None and found[5].changes is None
    assert found[3].ops == found[4].ops and found[3].stats.total_changes == 1


def test_the_comparison_runs_once(spark):
    frame = spark.createDataFrame([(1, FOX, WALKS)], "id int, source string, test string")
    found = C.with_changes(D.diff_pairs(frame)).withColumn("stats", C.stats()).where("stats.total_changes > 0").select("id", "stats.chars_added", "changes")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_facade_lifecycle(spark):
    own = TextDiff(FOX, spark=spark)
    for broken in (lambda: own.test, lambda: own.opcodes, own.compare, own.stats):
        with pytest.raises(ValueError, match="Cause:") as e:
            broken()
        assert "To fix:" in str(e.value)
    with pytest.raises(ValueError, match="Cause:"):
        TextDiff(None, spark=spark).source  # noqa: B018
    own.compare(WALKS, markdown_style="none")
    assert [c.operation for c in own.get_changes("replace")] == ["replace"] and own.get_changes("delete") == [] and own.edits == own.changes
    with pytest.raises(ValueError, match="Invalid operation"):
        own.get_changes("move")
    assert own.compare() == own.compare("") == "The quick brown fox <del>jumps over </del><ins>walks past </ins>the lazy dog."
    own.source = WALKS
    assert own.stats().total_changes == 0
    assert TextDiff("x", "", spark=spark).stats().deletions == 1
    assert [tuple(s) for s in own.compare(FOX, output="rich")][1:3] == [("walks past ", "strike red"), ("jumps over ", "green")]
    assert TextDiff("kitten", "sitting", spark=spark, levenshtein=True).stats().levenshtein_distance == 3


SENTENCE_PAIRS = [
    ("Ferries leave at dawn. Gulls follow them.", "Ferries leave at dawn. Gulls watched them."),
    ("Prof. Adeyemi thanked Mrs. Lindqvist warmly.", "Prof. Adeyemi greeted Mrs. Lindqvist warmly."),
    ("A kilo of plums costs 2.75 now.", "A kilo of plums costs 2.95 now."),
    ("Write to hello.example.net about it.", "Write to hello.example.org about it."),
    ("Compare fig. 7 with vol. 3 of the atlas.", "Compare fig. 7 with vol. 4 of the atlas."),
    ("K.M.T. Osei left the U.K. by boat.", "K.M.T. Osei left the U.S. by boat."),
    ("Bread rose. Kettles sang. Cats slept.", "Bread rose. Kettles whistled. Cats slept."),
    ("\"Is the tide out?\" asked Noor. \"Nearly!\" said Tom.", "\"Is the tide in?\" asked Noor. \"Nearly!\" said Tom."),
    ("Perhaps... no... leave it.", "Perhaps... yes... leave it."),
    ("The mill stands still.\n\nIts wheel is green.", "The mill stands still.\n\nIts wheel turned green."),
]


def test_sentence_processor(spark):
    rows = run(spark, [*SENTENCE_PAIRS, ("This is a test. Nothing changes.",) * 2], D.by_sentence())
    assert [len(rows[k].changes) for k in range(len(rows))] == [1] * len(SENTENCE_PAIRS) + [0]
    assert "Prof. " in rows[1].source_tokens and "¶ " not in rows[1].source_tokens
    assert rows[0].source_tokens.count("¶ ") == 1
    own = run(spark, [("a|b", "a|c")], D.by_sentence(lambda t: [(p, 0.5) for p in t.split("|")]))
    assert own[0].source_tokens == ["a ", "¶ ", "b"]


def test_sql_functions(spark):
    from emendra.functions.sql import register

    register(spark)
    spark.createDataFrame([(FOX, WALKS)], "source string, test string").createOrReplaceTempView("own_pairs")
    assert spark.sql("SELECT size(diff_ops(source, test).ops) AS n FROM own_pairs").first().n == 3
    assert spark.sql("SELECT mark_sentences('One. Two.') AS m").first().m == "One. ¶ Two."
    row = spark.sql("SELECT c.* FROM own_pairs, LATERAL text_changes(source, test) c").first()
    assert (row.operation, row.source_text, row.test_text, row.source_start) == ("replace", "jumps over ", "walks past ", 4)


def test_report_parts():
    s = {"total_changes": 1, "deletions": 0, "insertions": 0, "replacements": 1, "chars_added": 1, "chars_deleted": 2, "chars_net_change": -1, "change_ratio": 0.0025, "levenshtein_distance": 7}
    assert R.plain_stats_text(s).endswith("Change Ratio: 0.2%\nLevenshtein Distance: 7")
    assert "+1" in R.plain_stats_panel(s) and "-2" in R.plain_stats_panel(s)
