"""Queries of text cleaning, vocabularies and token streams."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import text as X
from lodestream.operators import vocabulary as V
from lodestream.plans.registry import Registry, table
from lodestream.scratch import written

REGISTRY = Registry()
add = REGISTRY.add

TOKENS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]')"
#: Entries of a vocabulary, specials included, and ids of a window: the reference's defaults.
SIZE, LENGTH = 30_000, 128


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


@add("word_tokens", f"SELECT doc_id, array_to_string({TOKENS}, ' ') AS tokens, len({TOKENS}) AS n FROM documents")
def word_tokens(spark: SparkSession, folder: str) -> DataFrame:
    words = X.tokens(F.col("text"))
    return _docs(spark, folder).select("doc_id", F.array_join(words, " ").alias("tokens"), F.size(words).cast("long").alias("n"))


_TOP = "WITH t AS (SELECT doc_id, unnest({list}) AS token, generate_subscripts({list}, 1) AS p FROM documents), c AS (SELECT token, count(*) AS n, min((doc_id, p)) AS f FROM t GROUP BY token), v AS (SELECT CAST(row_number() OVER (ORDER BY n DESC, f) + 3 AS INT) AS id, token, n FROM c QUALIFY id < {size})"
WORDS, CHARS = _TOP.format(list=TOKENS, size=SIZE), _TOP.format(list="string_split(text, '')", size=30_000)


@add("word_vocab", WORDS + " SELECT * FROM v")
def word_vocab(spark: SparkSession, folder: str) -> DataFrame:
    return V.frequent(_docs(spark, folder), "doc_id", X.tokens(F.col("text")), SIZE)


@add("char_vocab", CHARS + " SELECT * FROM v")
def char_vocab(spark: SparkSession, folder: str) -> DataFrame:
    return V.frequent(_docs(spark, folder), "doc_id", X.characters(F.col("text")), 30_000)


def _encoded(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The documents as ids, and the vocabulary; tokens are made once."""
    rows = written(_docs(spark, folder).select("doc_id", X.tokens(F.col("text")).alias("words")), "words")
    known = written(V.frequent(rows, "doc_id", F.col("words"), SIZE), "vocabulary")
    return V.encoded(rows, "doc_id", F.col("words"), known), known


@add(
    "token_encode",
    WORDS + " SELECT doc_id, '1 ' || string_agg(CAST(coalesce(id, 3) AS VARCHAR), ' ' ORDER BY p) || ' 2' AS ids FROM t LEFT JOIN v USING (token) GROUP BY doc_id",
)
def token_encode(spark: SparkSession, folder: str) -> DataFrame:
    return _encoded(spark, folder)[0].select("doc_id", F.array_join("ids", " ").alias("ids"))


@add("token_decode", WORDS + ", w AS (SELECT doc_id, string_agg(token, ' ' ORDER BY p) AS tokens FROM t JOIN v USING (token) GROUP BY doc_id) SELECT doc_id, coalesce(tokens, '') AS tokens FROM documents LEFT JOIN w USING (doc_id)")
def token_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Ids back to tokens; the unknown ones are gone."""
    ids, known = _encoded(spark, folder)
    out = V.decoded(ids, "doc_id", "ids", known)
    return out.select("doc_id", F.array_join("tokens", " ").alias("tokens"))


@add(
    "next_token_windows",
    WORDS
    + f""", s AS (SELECT doc_id, p, coalesce(id, 3) AS id FROM t LEFT JOIN v USING (token) UNION ALL SELECT doc_id, 0, 1 FROM documents UNION ALL SELECT doc_id, 1000000000, 2 FROM documents),
    o AS (SELECT row_number() OVER (ORDER BY doc_id, p) - 1 AS i, id FROM s), x AS (SELECT i // {LENGTH} AS w, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY i) AS x, count(*) AS n FROM o GROUP BY 1),
    y AS (SELECT (i - 1) // {LENGTH} AS w, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY i) AS y, count(*) AS n FROM o WHERE i > 0 GROUP BY 1)
    SELECT x.w AS "window", x, y FROM x JOIN y USING (w) WHERE x.n = {LENGTH} AND y.n = {LENGTH}""",
)
def next_token_windows(spark: SparkSession, folder: str) -> DataFrame:
    out = V.windows(_encoded(spark, folder)[0], "doc_id", "ids", LENGTH)
    return out.select("window", F.array_join("x", " ").alias("x"), F.array_join("y", " ").alias("y"))


@add("token_pairs", f"WITH t AS (SELECT doc_id, unnest({TOKENS}) AS a, generate_subscripts({TOKENS}, 1) AS p FROM documents), q AS (SELECT a, lead(a) OVER (PARTITION BY doc_id ORDER BY p) AS b FROM t) SELECT a, b, count(*) AS n FROM q WHERE b IS NOT NULL GROUP BY a, b")
def token_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Adjacent pairs, made inside each text without a window."""
    words = _docs(spark, folder).select(X.tokens(F.col("text")).alias("w"))
    pairs = F.arrays_zip(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))).alias("a"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("b"))
    return words.select(F.explode(pairs).alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("n"))


@add("text_lines", "SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l) <> '' GROUP BY doc_id")
def text_lines(spark: SparkSession, folder: str) -> DataFrame:
    """How many lines of each text aren't blank."""
    return _docs(spark, folder).select("doc_id", F.explode(F.split("text", "\n")).alias("l")).where(F.trim("l") != "").groupBy("doc_id").agg(F.count("*").alias("lines"))


@add("text_tidy", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]*\n[ \t]*', chr(10), 'g'), '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS text FROM documents")
def text_tidy(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", X.tidy(F.col("text")).alias("text"))


def _clean(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", X.tidy(X.removed(F.col("text"))).alias("text"))


def _clean_sql() -> str:
    out = "text"
    for p in X.REMOVED:
        flags = "g" + ("i" if "i" in p.partition(")")[0] and p.startswith("(?m") else "")
        body = "(?m)" + p.partition(")")[2] if p.startswith("(?m") else p
        out = f"regexp_replace({out}, '{body.replace(chr(39), chr(39) * 2)}', '', '{flags}')"
    return r"WITH c AS (SELECT doc_id, " + out + r" AS text FROM documents) SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]*\n[ \t]*', chr(10), 'g'), '^[\s\x0b]+|[\s\x0b]+$', '', 'g') AS text FROM c"


@add("text_clean", _clean_sql())
def text_clean(spark: SparkSession, folder: str) -> DataFrame:
    return _clean(spark, folder)


@add("text_residuals", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\b\d+:\d+\b')) AS INT) AS refs, CAST(len(regexp_extract_all(text, '(?mi)^(?:Chapter\s+\d+|PSALM\s+\d+)$')) AS INT) AS headings FROM documents")
def text_residuals(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", X.residuals(F.col("text"), "references").alias("refs"), X.residuals(F.col("text"), "headings").alias("headings"))


def _reflow_sql() -> str:
    """Each paragraph by a list of its phrases; the phrase before decides whether a long one is set off."""
    text = r"regexp_replace(text, '([.!?;:])\s+', '\1 <SPLIT> ', 'g')"
    for words in X.TRIGGERS:
        text = rf"regexp_replace({text}, '\s*(\b(?:{'|'.join(words)})\b)\s*', ' <SPLIT>\1<SPLIT> ', 'gi')"
    starts = f"(?i)^(?:{'|'.join(w for ws in X.TRIGGERS for w in ws)})\\b"
    blank = r"[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]"
    return (
        _clean_sql().removesuffix(" FROM c") + f" FROM c), m AS (SELECT doc_id, {text} AS text FROM d), b AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS block, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i FROM m),"
        f" p AS (SELECT doc_id, i, trim(unnest(string_split(regexp_replace(block, '{blank}+', ' ', 'g'), '<SPLIT>'))) AS p, generate_subscripts(string_split(regexp_replace(block, '{blank}+', ' ', 'g'), '<SPLIT>'), 1) AS j FROM b),"
        f" q AS (SELECT *, length(p) <= 60 OR regexp_matches(p, '[.!?;:]$') OR regexp_matches(p, '{starts}') AS alone FROM p WHERE p <> ''),"
        " r AS (SELECT *, coalesce(lag(alone) OVER (PARTITION BY doc_id, i ORDER BY j), true) AS free FROM q),"
        " l AS (SELECT doc_id, i, string_agg(CASE WHEN free AND NOT alone AND length(p) >= 100 THEN chr(10) ELSE '' END || p, chr(10) ORDER BY j) AS lines FROM r GROUP BY doc_id, i),"
        " t AS (SELECT doc_id, string_agg(lines, chr(10) || chr(10) ORDER BY i) AS text FROM l GROUP BY doc_id)"
        " SELECT doc_id, CASE WHEN m.text IS NOT NULL THEN coalesce(t.text, '') || chr(10) END AS text FROM m LEFT JOIN t USING (doc_id)"
    ).replace(") SELECT doc_id, regexp_replace", "), d AS (SELECT doc_id, regexp_replace", 1)


@add("text_reflow", _reflow_sql())
def text_reflow(spark: SparkSession, folder: str) -> DataFrame:
    return _clean(spark, folder).select("doc_id", X.reflowed(X.marked(F.col("text"))).alias("text"))


@add(
    "text_detokenize",
    rf"""WITH t AS (SELECT doc_id, unnest({TOKENS}) AS token, generate_subscripts({TOKENS}, 1) AS p FROM documents), w AS (SELECT *, regexp_matches(token, '^[\p{{L}}\p{{N}}_]') AS word FROM t),
    b AS (SELECT *, coalesce(word AND lag(word) OVER (PARTITION BY doc_id ORDER BY p), false) AS blank FROM w), j AS (SELECT doc_id, string_agg(CASE WHEN blank THEN ' ' ELSE '' END || token, '' ORDER BY p) AS text FROM b GROUP BY doc_id)
    SELECT doc_id, coalesce(j.text, '') AS text FROM documents LEFT JOIN j USING (doc_id)""",
)
def text_detokenize(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", X.joined(X.tokens(F.col("text"))).alias("text"))


#: Public tokenizers: a byte-level one, and one whose merges end words.
BPE, WORD_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/word_bpe_49k.json"


def merges(path: str = WORD_BPE) -> list[tuple[str, str]]:
    """The merges of a tokenizer file, in order."""
    found = json.loads(Path(path).read_text(encoding="utf-8"))["model"]["merges"]
    return [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in found]


def _replay_sql(path: str = WORD_BPE) -> str | None:
    """The merges one by one, as replacements; none without the file."""
    if not Path(path).exists():
        return None
    quoted = lambda *xs: "".join(f"chr(1) || '{x.replace(chr(39), chr(39) * 2)}' || chr(2) || " for x in xs) + "''"
    out = "start"
    for a, b in merges(path)[:200]:
        out = f"replace({out}, {quoted(a, b)}, {quoted(a + b)})"
    return f"""WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest({TOKENS.replace("(text,", "(lower(text),")}) AS word FROM documents) GROUP BY word),
    s AS (SELECT word, n, chr(1) || array_to_string(string_split(word, ''), chr(2) || chr(1)) || '</w>' || chr(2) AS start FROM w)
    SELECT word, n, replace(substr(m, 2, length(m) - 2), chr(2) || chr(1), ' ') AS symbols FROM (SELECT word, n, {out} AS m FROM s)"""


@add("bpe_replay", _replay_sql())
def bpe_replay(spark: SparkSession, folder: str) -> DataFrame:
    """The first 200 merges of a public tokenizer replayed over the characters of each distinct word; the words are counted first, so each is merged once."""
    words = written(_docs(spark, folder).select(F.explode(X.tokens(F.lower("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")), "words")
    symbols = X.characters(F.col("word"))
    ended = F.concat(F.slice(symbols, 1, F.size(symbols) - 1), F.array(F.concat(F.element_at(symbols, -1), F.lit("</w>"))))
    return words.select("word", "n", F.array_join(X.merged(ended, merges()[:200]), " ").alias("symbols"))


@add("bpe_encode")
def bpe_encode(spark: SparkSession, folder: str, path: str = BPE) -> DataFrame:
    """Every document, whole, as ids of a given public tokenizer."""
    return V.given_encoded(_docs(spark, folder), "doc_id", "text", Path(path).read_text(encoding="utf-8"))


@add("bpe_decode", "SELECT doc_id, text FROM documents")
def bpe_decode(spark: SparkSession, folder: str, path: str = BPE) -> DataFrame:
    """Ids back to texts: byte-level merges lose nothing."""
    return V.given_decoded(bpe_encode(spark, folder, path), "doc_id", "ids", Path(path).read_text(encoding="utf-8"))


@add("hash_ids", "SELECT doc_id, md5(lang || '_' || source) AS key, substr(sha1(lang || '_' || source), 1, 12) AS id FROM documents")
def hash_ids(spark: SparkSession, folder: str) -> DataFrame:
    both = F.concat("lang", F.lit("_"), "source")
    return table(spark, folder, "documents").select("doc_id", F.md5(both).alias("key"), F.substring(F.sha1(both), 1, 12).alias("id"))
