"""The training-data operators as queries over the driver's tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from emendra.llm import byte_bpe, chat_format, decontaminate, exact_dedup, html_wrapper, secret_scan, simhash, suffix_dedup, toxicity, trie_counts
from emendra.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract_main_text(table(spark, sf_dir, "pages"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.bpe_digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_digests(table(spark, sf_dir, "documents"))


def op4_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_counts.token_counts(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("removed", "kept")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(docs, toxicity.fit_model(docs, table(spark, sf_dir, "labels")))


#: A conversation whose texts are made of the template's own control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id AS bigint) AS conv_id", "cast(turn AS bigint) AS turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], given.schema)
    return chat_format.chat_digests(chat_format.chat_examples(given.unionByName(own)))


QUERIES = {f.__name__: f for f in (op1_html_wrapper, op2_byte_bpe, op3_simhash, op4_trie_counts, op5_exact_dedup, op6_suffix_dedup, op7_secret_scan, op8_decontaminate, op9_toxicity, op10_chat_format)}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Words of decontamination, for RE2.
WORD_RE2 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _either_case(pattern: str) -> str:
    """A pattern with each letter in either case spelt out, as case folding would go beyond ASCII."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in pattern)


#: Pattern and condition (on m, a match) of each kind of secret, in order; the kinds after the third are the method's own.
SECRETS = {
    "assign": ("(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "length(regexp_extract(m, '{pattern}', 2)) >= 8"),
    "access": ("AKIA[A-Z0-9]+", "length(m) >= 16"),
    "hex": ("[0-9a-f]+", "length(m) >= 32"),
    "github": ("gh[pousr]_[A-Za-z0-9]+", "length(m) >= 40"),
    "slack": ("xox[abprs]-[A-Za-z0-9-]+", "length(m) >= 15"),
    "pem": ("-----BEGIN [A-Z ]*PRIVATE KEY-----+", "true"),
}


def _secret_matches(order: int, kind: str) -> str:
    """SQL for (rid, o, kind, a, b): all matches of a kind; they alternate with the pieces between them."""
    pattern = SECRETS[kind][0].replace("'", "''")
    return f"""SELECT rid, {order} AS o, '{kind}' AS kind, a, a + length(m) AS b FROM (
            SELECT rid, ms[i] AS m, list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS a
            FROM (SELECT rid, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
                SELECT rid, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS ps FROM t)))
        WHERE {SECRETS[kind][1].format(pattern=pattern)}"""


def _escaped_length(column: str) -> str:
    """SQL for the length of an escaped text: a backslash more for each backslash and each control string."""
    extra = " + ".join(f"(length({column}) - length(replace({column}, '{c}', ''))) // {len(c)}" for c in ("\\", *chat_format.CONTROLS))
    return f"(length({column}) + {extra})"


ORACLE_SQL = {
    "op5_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    # texts as hexadecimal digits, windows cut from blocks of 512 bytes, as a cut from a long string costs its length
    "op6_suffix_dedup": """
        WITH t AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        c AS (SELECT rid, o, substr(x, 2 * o + 1, 2 * (512 + 199)) AS own FROM (SELECT rid, x, unnest(range(0, length(x) // 2, 512)) AS o FROM t)),
        w AS MATERIALIZED (SELECT rid, o + i AS i, md5_number(substr(own, 2 * i + 1, 400)) AS k FROM (SELECT rid, o, own, unnest(range(0, least(512, length(own) // 2 - 199))) AS i FROM c)),
        r AS (SELECT rid, i FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
        s AS (SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM r),
        g AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS run FROM s),
        z AS MATERIALIZED (SELECT rid, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY rid, run),
        p AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS since FROM z),
        k AS (SELECT rid, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS ends, string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept FROM p JOIN t USING (rid) GROUP BY rid)
        SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(ends, 0) + 1))) AS kept_sha256
        FROM t LEFT JOIN k USING (rid)""",
    "op7_secret_scan": f"""
        WITH t AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
        m AS MATERIALIZED ({" UNION ALL ".join(_secret_matches(k, kind) for k, kind in enumerate(SECRETS))}),
        g AS (SELECT rid, count(*) FILTER (o = 0) AS n0, count(*) FILTER (o = 1) AS n1, count(*) FILTER (o = 2) AS n2,
                     string_agg(concat(kind, ':', CAST(a AS BIGINT), ':', CAST(b AS BIGINT)), ',' ORDER BY a, o) AS spans,
                     string_agg(concat(kind, ':', CAST(a AS BIGINT), ':', CAST(b AS BIGINT)), ',' ORDER BY a, o) FILTER (o < 3) AS base FROM m GROUP BY rid)
        SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM t LEFT JOIN g USING (rid)""",
    "op8_decontaminate": f"""
        WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD_RE2}') AS ws FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD_RE2}') AS ws FROM benchmark),
        w AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM (
            SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
        o AS MATERIALIZED (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM (
            SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM w) WHERE len(ws) >= n)),
        h AS MATERIALIZED (SELECT doc_id, i, o.n, item_id FROM o JOIN w USING (n, win)),
        k AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM h) GROUP BY doc_id),
        t AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN k USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op10_chat_format": f"""
        WITH c AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'),
        m AS (SELECT *, CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 ELSE 29 + {_escaped_length("role")} END + {_escaped_length("text")} AS chars FROM c),
        p AS (SELECT *, 3 + sum(chars) OVER (PARTITION BY conv_id ORDER BY turn) AS upto, turn = max(turn) OVER (PARTITION BY conv_id) AS ends FROM m)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(upto) FILTER (role = 'assistant' OR ends) AS BIGINT) AS formatted_chars
        FROM p GROUP BY conv_id""",
}
