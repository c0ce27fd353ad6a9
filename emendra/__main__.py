"""Command line: python -m emendra [compare|text|simple-text|markdown|json|stats|guide] SOURCE TEST.

SOURCE and TEST are texts or paths of text or PDF files. With --edit-distance
the figures hold the Levenshtein distance, which takes time in proportion to the
product of both lengths. Exit codes: 0 there are changes, 1 there are none, 2 error.
"""

from __future__ import annotations

import argparse
import os
import sys

from emendra.functions.render import MarkdownStyle, plain_stats_panel, plain_stats_text

COMMANDS = ("compare", "text", "simple-text", "markdown", "json", "stats", "guide")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="emendra", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in COMMANDS[:-1]:
        own = commands.add_parser(name)
        own.add_argument("source")
        own.add_argument("test")
        if name in ("compare", "json"):
            own.add_argument("-p", "--pretty", action="store_true")
        if name in ("compare", "json", "text", "stats"):
            own.add_argument("-e", "--edit-distance", action="store_true")
        if name in ("text", "markdown", "stats"):
            own.add_argument("-q", "--quiet", action="store_true")
        if name == "markdown":
            own.add_argument("-m", "--markdown-style", type=str.lower, choices=[s.value for s in MarkdownStyle], default="red_green")
    commands.add_parser("guide")
    return parser


def _guide() -> str:
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "README.md"), encoding="utf-8") as f:
        return f.read()


def _spark():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None:
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0] not in (*COMMANDS, "-h", "--help"):
        argv.insert(0, "compare")
    args = _parser().parse_args(argv)
    if args.command == "guide":
        print(_guide())
        return 0
    from pyspark.errors import PySparkException

    try:
        return _compare(args)
    except ValueError as e:
        print(f"Error: {e}", file=sys.stderr)
    except (PySparkException, OSError) as e:
        print(f"Error: The comparison failed.\n\nCause: {str(e).splitlines()[0]}\n\nTo fix: check that both inputs can be read.", file=sys.stderr)
    return 2


def _compare(args: argparse.Namespace) -> int:
    from emendra.facade import TextDiff
    from emendra.sources.text_files import read_input

    spark = _spark()
    texts = [read_input(spark, x) for x in (args.source, args.test)]
    options = {"markdown_style": args.markdown_style} if args.command == "markdown" else {}
    diff = TextDiff(*texts, spark=spark, levenshtein=getattr(args, "edit_distance", False), **options)
    stats = diff.stats().asDict()
    if args.command in ("compare", "json"):
        print(diff.output_json(args.pretty))
        if args.command == "compare" and sys.stdout.isatty():
            print("Tip: `stats`, `text` and `markdown` show the comparison in other forms.", file=sys.stderr)
    elif args.command == "simple-text":
        print(diff.output_ansi)
    elif args.command == "text":
        if not args.quiet:
            print(f"Source: {texts[0]}\nTest:   {texts[1]}\n")
        print(diff.output_ansi)
        if not args.quiet:
            print(plain_stats_panel(stats))
    elif args.command == "markdown":
        if not args.quiet:
            print(f"Markdown ({args.markdown_style}):\n")
        print(diff.output_markdown)
    else:
        print(plain_stats_text(stats) if args.quiet else plain_stats_panel(stats))
    return 0 if stats["total_changes"] else 1


if __name__ == "__main__":
    sys.exit(main())
