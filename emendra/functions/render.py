"""Renderings of compared pairs: track-changes markup, styled spans, JSON, statistics as text, HTML sections.

None of them escapes its text, like the markup it stands for.
"""

from __future__ import annotations

import json
from enum import Enum

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emendra.functions import changes as C
from emendra.functions import text as T


class MarkdownStyle(str, Enum):
    NONE = "none"
    RED_GREEN = "red_green"
    RED = "red"
    GHFM = "ghfm"
    BBCODE = "bbcode"
    STREAMLIT = "streamlit"


class OutputType(str, Enum):
    MARKDOWN = "markdown"
    RICH = "rich"


#: What opens and closes an insertion and a deletion in each style.
MARKUP = {
    "none": ("<ins>", "</ins>", "<del>", "</del>"),
    "red_green": ("<span style='color:green;font-weight:700;'>", "</span>", "<span style='color:red;font-weight:700;text-decoration:line-through;'>", "</span>"),
    "red": ("<span style='color:red;font-weight:700;'>", "</span>", "<span style='color:red;font-weight:700;text-decoration:line-through;'>", "</span>"),
    "ghfm": ("**", "**", "~~", "~~"),
    "bbcode": ("[b][color=green]", "[/color][/b]", "[s][color=red]", "[/color][/s]"),
    "streamlit": ("**:green[", "]** ", "~~:red[", "]~~ "),
}


def markup_of(style: str | MarkdownStyle | None, ins_class: str = "redline-inserted", del_class: str = "redline-deleted") -> tuple[str, str, str, str]:
    """Opening and closing markup of a style; an unknown one is shown in red and green, None as "none"."""
    name = "none" if style is None else style.value if isinstance(style, MarkdownStyle) else style
    if name == "custom_css":
        return f"<span class='{ins_class}'>", "</span>", f"<span class='{del_class}'>", "</span>"
    return MARKUP.get(name, MARKUP["red_green"])


def _sides(op: Column) -> tuple[Column, Column]:
    return T.join_tokens(F.col("source_tokens"), op["i1"], op["i2"]), T.join_tokens(F.col("test_tokens"), op["j1"], op["j2"])


def markdown(style: str | MarkdownStyle | None = "red_green", **classes: str) -> Column:
    """Track-changes markup. Marks become empty lines in equal text, separate insertions, and stay in deletions."""
    ins, ins_end, gone, gone_end = markup_of(style, **classes)

    def shown(op: Column) -> Column:
        source, test = _sides(op)
        deleted = F.concat(F.lit(gone), source, F.lit(gone_end))
        inserted = F.array_join(F.transform(T.split_at_mark(test), lambda part: F.concat(F.lit(ins), part, F.lit(ins_end))), "\n\n")
        return F.when(op["tag"] == "equal", T.unmark(source)).when(op["tag"] == "delete", deleted).when(op["tag"] == "insert", inserted).otherwise(F.concat(deleted, inserted))

    return F.array_join(F.transform("ops", shown), "")


def spans() -> Column:
    """array<struct<text, style>>: unstyled, "green" and "strike red" spans; empty ones are left out."""

    def span(text: Column, style: str | None) -> Column:
        return F.struct(text.alias("text"), F.lit(style).cast("string").alias("style"))

    def shown(op: Column) -> Column:
        source, test = _sides(op)
        deleted = F.array(span(source, "strike red"))
        inserted = F.transform(T.split_at_mark(test), lambda part: span(part, "green"))
        return F.when(op["tag"] == "equal", F.array(span(T.unmark(source), None))).when(op["tag"] == "delete", deleted).when(op["tag"] == "insert", inserted).otherwise(F.concat(deleted, inserted))

    return F.filter(F.flatten(F.transform("ops", shown)), lambda s: s["text"] != "")


#: Terminal codes of the styles.
ANSI = {"green": "\x1b[32m", "strike red": "\x1b[9;31m"}


def ansi(column: str = "spans") -> Column:
    """Styled spans as one string for a terminal."""
    coded = lambda s: F.when(s["style"] == "green", F.concat(F.lit(ANSI["green"]), s["text"], F.lit("\x1b[0m"))).when(s["style"] == "strike red", F.concat(F.lit(ANSI["strike red"]), s["text"], F.lit("\x1b[0m"))).otherwise(s["text"])
    return F.array_join(F.transform(column, coded), "")


CHANGE = "struct<type: string, text: string, source_text: string, test_text: string, source_position: array<int>, test_position: array<int>, source_token_position: array<int>, test_token_position: array<int>>"
#: Schema that reads the JSON back.
JSON_SCHEMA = (
    f"struct<source: string, test: string, source_tokens: array<string>, test_tokens: array<string>, changes: array<{CHANGE}>, "
    "stats: struct<deletions: int, insertions: int, replacements: int, unchanged: int, total_changes: int, longest_change_length: int, shortest_change_length: int, "
    "average_change_length: double, change_ratio: double, chars_added: int, chars_deleted: int, chars_net_change: int, levenshtein_distance: int>>"
)


def json_changes() -> Column:
    """All operations, equal ones too, with token positions and with character positions in the unmarked texts."""

    def sized(op: Column) -> Column:
        source, test = (T.unmark(x) for x in _sides(op))
        return F.struct(op.alias("op"), source.alias("s"), test.alias("t"))

    rows = F.transform("ops", sized)
    start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("t"), F.array().cast("array<struct<s: int, t: int>>").alias("at"))
    offsets = F.aggregate(
        rows,
        start,
        lambda a, r: F.struct((a["s"] + F.length(r["s"])).alias("s"), (a["t"] + F.length(r["t"])).alias("t"), F.concat(a["at"], F.array(F.struct(a["s"].alias("s"), a["t"].alias("t")))).alias("at")),
        lambda a: a["at"],
    )

    def change(r: Column, at: Column) -> Column:
        op, tag = r["op"], r["op"]["tag"]
        has_source, has_test = tag != "insert", tag != "delete"
        pair = lambda a, b: F.array(a, b)
        return F.struct(
            tag.alias("type"),
            F.when(tag == "insert", r["t"]).when(tag != "replace", r["s"]).alias("text"),
            F.when(tag == "replace", r["s"]).alias("source_text"),
            F.when(tag == "replace", r["t"]).alias("test_text"),
            F.when(has_source, pair(at["s"], at["s"] + F.length(r["s"]))).alias("source_position"),
            F.when(has_test, pair(at["t"], at["t"] + F.length(r["t"]))).alias("test_position"),
            F.when(has_source, pair(op["i1"], op["i2"])).alias("source_token_position"),
            F.when(has_test, pair(op["j1"], op["j2"])).alias("test_token_position"),
        )

    return F.zip_with(rows, offsets, change)


#: Keys of each kind of change, in order; a position that a kind lacks is null.
_POSITIONS = ("source_position", "test_position", "source_token_position", "test_token_position")
_STATS_ORDER = ("deletions", "insertions", "replacements", "unchanged", "total_changes", *C.STATS[4:])


def _plain(value):
    return value.tolist() if hasattr(value, "tolist") else value


def with_json(diffed: DataFrame, pretty: bool = False, levenshtein: bool = False) -> DataFrame:
    """`diffed` with a column `json`: both texts, tokens, changes and statistics, byte for byte as Python's json writes them."""

    def dump(rows: pd.DataFrame) -> pd.Series:
        out = []
        for row in rows.itertuples(index=False):
            if row.ops_json is None:
                out.append(None)
                continue
            changes = []
            for c in row.ops_json:
                texts = ("source_text", "test_text") if c["type"] == "replace" else ("text",)
                changes.append({k: _plain(c[k]) for k in ("type", *texts, *_POSITIONS)})
            tokens = [[t.replace("¶ ", "\n\n") for t in own] if changes else [] for own in (row.source_tokens, row.test_tokens)]
            own = row.stats | {"unchanged": sum(c["type"] == "equal" for c in changes)}
            whole = {"source": row.source, "test": row.test, "source_tokens": tokens[0], "test_tokens": tokens[1], "changes": changes, "stats": {k: own[k] for k in _STATS_ORDER}}
            out.append(json.dumps(whole, ensure_ascii=False, indent=2 if pretty else None))
        return pd.Series(out, dtype=object)

    dumped = F.pandas_udf(dump, "string")
    ready = diffed.withColumn("_changes", C.changes())
    packed = F.struct("source", "test", "source_tokens", "test_tokens", json_changes().alias("ops_json"), C.stats("_changes", levenshtein=levenshtein).alias("stats"))
    return ready.withColumn("json", dumped(packed)).drop("_changes")


def json_problems(column: str = "json") -> Column:
    """What is wrong with a document of the JSON form, as an array of texts: it must be readable, each change must have what its kind has and no more, and the figures must agree."""
    whole = F.from_json(column, JSON_SCHEMA)
    changes, stats = whole["changes"], whole["stats"]
    sides = {"equal": ("source", "test"), "delete": ("source",), "insert": ("test",), "replace": ("source", "test")}

    def fits(c: Column, kind: str) -> Column:
        own = F.lit(True)
        for side in ("source", "test"):
            for name in (f"{side}_position", f"{side}_token_position"):
                there = (F.size(c[name]) == 2) & (c[name][0] <= c[name][1])
                own = own & (F.coalesce(there, F.lit(False)) if side in sides[kind] else c[name].isNull())
        for name in ("text", "source_text", "test_text"):
            own = own & (c[name].isNotNull() if (name != "text") == (kind == "replace") else c[name].isNull())
        return own

    def problem(c: Column, k: Column) -> Column:
        at = F.concat(F.lit("change "), k.cast("string"))
        wrong = F.when(~F.coalesce(c["type"].isin(*sides), F.lit(False)), F.concat(at, F.lit(": unknown type")))
        for kind in sides:
            wrong = wrong.when((c["type"] == kind) & ~fits(c, kind), F.concat(at, F.lit(f": not what {kind} has")))
        return wrong

    def count(kind: str) -> Column:
        return F.size(F.filter(changes, lambda c: c["type"] == kind))

    figures = [
        F.when(stats[name].isNull() | (stats[name] != count(kind)), F.lit(f"{name}: not the number of changes"))
        for name, kind in (("deletions", "delete"), ("insertions", "insert"), ("replacements", "replace"), ("unchanged", "equal"))
    ]
    figures.append(F.when(stats["total_changes"] != stats["deletions"] + stats["insertions"] + stats["replacements"], F.lit("total_changes: not the sum of its kinds")))
    figures.append(F.when(stats["chars_net_change"] != stats["chars_added"] - stats["chars_deleted"], F.lit("chars_net_change: not the difference")))
    found = F.filter(F.concat(F.transform(changes, problem), F.array(*figures)), lambda x: x.isNotNull())
    return F.when(whole.isNull() | changes.isNull() | stats.isNull(), F.array(F.lit("not readable"))).otherwise(found)


def plain_stats_text(s: dict) -> str:
    """Statistics as lines of text."""
    lines = [
        f"Total Changes: {s['total_changes']}",
        f"Deletions: {s['deletions']}",
        f"Insertions: {s['insertions']}",
        f"Replacements: {s['replacements']}",
        f"Characters Added: {s['chars_added']}",
        f"Characters Deleted: {s['chars_deleted']}",
        f"Net Change: {s['chars_net_change']}",
        f"Change Ratio: {s['change_ratio']:.1%}",
    ]
    if s["levenshtein_distance"] is not None and s["levenshtein_distance"] == s["levenshtein_distance"]:
        lines.append(f"Levenshtein Distance: {int(s['levenshtein_distance'])}")
    return "\n".join(lines)


def stats_text(column: str = "stats") -> Column:
    """Statistics of a pair as lines of text; percentages are rounded as Python rounds them."""

    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([plain_stats_text(r) for r in rows.to_dict("records")], dtype=object)

    return F.pandas_udf(run, "string")(F.col(column))


def plain_stats_panel(s: dict, width: int = 40) -> str:
    """Statistics in a box, with signs."""
    rows = [("Total Changes", s["total_changes"]), ("Deletions", s["deletions"]), ("Insertions", s["insertions"]), ("Replacements", s["replacements"]), ("Characters Added", f"+{s['chars_added']}"), ("Characters Deleted", f"-{s['chars_deleted']}"), ("Net Change", s["chars_net_change"]), ("Change Ratio", f"{s['change_ratio']:.1%}")]
    if s["levenshtein_distance"] is not None:
        rows.append(("Levenshtein Distance", s["levenshtein_distance"]))
    body = [f"│ {name:<22}{value!s:<{width - 26}} │" for name, value in rows]
    return "\n".join(["╭─ Statistics " + "─" * (width - 15) + "╮", *body, "╰" + "─" * (width - 2) + "╯"])


def stats_panel(column: str = "stats") -> Column:
    """Statistics of a pair in a box."""

    def run(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([plain_stats_panel(r | {"levenshtein_distance": None if pd.isna(r["levenshtein_distance"]) else int(r["levenshtein_distance"])}) for r in rows.to_dict("records")], dtype=object)

    return F.pandas_udf(run, "string")(F.col(column))


def html_section(name: str = "path", stats: str = "stats", shown: str = "markdown") -> Column:
    """A pair's section of an HTML report: its name, a list of figures, and the comparison or that there is nothing to see."""
    s = F.col(stats)
    figures = {
        "edits": s["total_changes"],
        "taken out": s["deletions"],
        "put in": s["insertions"],
        "swapped": s["replacements"],
        "longer by": s["chars_net_change"],
        "per mille touched": F.floor(s["change_ratio"] * 1000),
    }
    listed = [x for label, value in figures.items() for x in (F.lit(f"<dt>{label}</dt><dd>"), value.cast("string"), F.lit("</dd>"))]
    same = s["total_changes"] == 0
    body = F.when(same, F.lit("<p>Nothing differs.</p>")).otherwise(F.concat(F.lit("<blockquote>"), F.col(shown), F.lit("</blockquote>")))
    return F.concat(F.when(same, F.lit('<section class="same"><h2>')).otherwise(F.lit('<section class="edited"><h2>')), F.col(name), F.lit("</h2><dl>"), *listed, F.lit("</dl>"), body, F.lit("</section>"))


REPORT_HEAD = """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>Compared texts</title>
<style>body{font:1rem/1.5 serif;max-width:60rem;margin:auto}section{border-top:2px solid}section.same{opacity:.6}dl{display:flex;gap:.3rem 1rem;flex-wrap:wrap}dd{margin:0;font-weight:bold}
ins{background:#e0ffe0}del{background:#ffe0e0}</style></head><body>
"""


def write_report(sections: DataFrame, summary: DataFrame, path: str, column: str = "section", order: str = "path") -> None:
    """An HTML report as a folder of text parts in order: the head with the summary, then a section for each file.

    `summary` is the one row of `report_summary`; sections are written where
    they are made, so a report may cover any number of files.
    """
    total = summary.first().asDict()
    head = REPORT_HEAD + "<h1>Compared texts</h1><ul>" + "".join(f"<li>{k.replace('_', ' ')}: {v}</li>" for k, v in total.items()) + "</ul>"
    spark = sections.sparkSession
    ends = spark.createDataFrame([(0, "", head), (2, "", "</body></html>")], "part int, name string, value string")
    body = sections.select(F.lit(1).alias("part"), F.col(order).cast("string").alias("name"), F.regexp_replace(column, "\n", "<br>").alias("value"))
    ends.unionByName(body).orderBy("part", "name").select("value").write.text(path)
