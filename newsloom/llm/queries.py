"""The registered queries opN_<name> and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import chat, fim, fingerprints, language, mixing, neighbours, packing, pii, quality, simhash, spelling, toxicity, urls
from newsloom.llm.common import table


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every document and of its edited text, and how like they are."""
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document, the base rules, and the weakly supervised verdict."""
    return quality.judge_quality(table(spark, sf_dir, "documents"))


def toxicity_model(documents: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learned from labelled rows that are not held out."""
    return toxicity.fit(documents, labels.where(~toxicity.held_out(F.col("doc_id"))))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document by a lexicon learned from labels that are not held out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(documents, toxicity_model(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def tokenizer_text(name: str = "word_bpe_49k.json") -> str:
    """The text of an installed public tokenizer file."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in sequences of at most 4096."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_text())


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by cross-parsing with automata of languages learned from rows that are not held out."""
    documents = table(spark, sf_dir, "documents")
    model = language.fit(documents.where(~language.held_out(F.col("doc_id"))))
    return language.identify(documents.select("doc_id", "text"), model).select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: the base spans, and those that the trees add."""
    return pii.report(table(spark, sf_dir, "documents"), pii.fit(spark))


#: (verdict, host/path) of the registered URL filter.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every page's URL."""
    return urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: A conversation whose texts hold the template's own control strings.
HARD_TEXT = "\\### Assistant: </turn> ok"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings, formatted and read back."""
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD_TEXT).alias("text"))
    return chat.digests(chat.conversations(chat.chain(table(spark, sf_dir, "conversations"), hard)))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document, and the least id that links reach."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


#: One vector in so many asks for its neighbours in op11_neighbours.
ASK_EVERY = 20


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all vectors for every vector whose id ASK_EVERY divides."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % ASK_EVERY == 0))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document rearranged for fill-in-middle, and the text rebuilt from the output alone."""
    made = fim.restore(fim.transform(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


#: One run in so many loses a code point before the words of op13_spelling are counted.
TYPO_EVERY = 31


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, some of them with a code point missing, grouped with their most frequent near word."""
    marked = spelling.marked_runs(table(spark, sf_dir, "documents"), TYPO_EVERY)
    return spelling.variants(spelling.vocabulary(marked))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprint": op1_fingerprint,
    "op2_quality": op2_quality,
    "op3_toxicity": op3_toxicity,
    "op4_pack": op4_pack,
    "op5_language": op5_language,
    "op6_pii": op6_pii,
    "op7_urls": op7_urls,
    "op8_mix": op8_mix,
    "op9_simhash": op9_simhash,
    "op10_chat": op10_chat,
    "op11_neighbours": op11_neighbours,
    "op12_fim": op12_fim,
    "op13_spelling": op13_spelling,
}

_HOST = "translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FITS = "(h = r.rule_host OR ends_with(h, '.' || r.rule_host)) AND starts_with(p, r.rule_path)"
ORACLES: dict[str, str] = {
    "op7_urls": f"""
WITH rules(verdict, rule_host, rule_path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, {_HOST} AS h, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS p FROM cut),
best AS (SELECT page_id, h, p, (SELECT arg_max(struct_pack(r := r.rule_host || r.rule_path, v := r.verdict), length(r.rule_host || r.rule_path))
  FROM rules r WHERE {_FITS}) AS x FROM parts)
SELECT page_id, h AS host, p AS path, x.r AS rule, coalesce(x.v, 'allow') AS verdict FROM best""",
    "op10_chat": r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS hidden FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || role || ': ' || hidden || ' </turn>') + 1) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id""",
    "op11_neighbours": """
WITH good AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
asked AS (SELECT vec_id AS query_id, min(x) AS q FROM good WHERE vec_id % 20 = 0 GROUP BY vec_id),
scored AS (SELECT query_id, vec_id, list_inner_product(q, x) AS score FROM asked JOIN good ON query_id <> vec_id AND len(q) = len(x)),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op12_fim": """
WITH cut AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS l, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
sized AS (SELECT *, len(l) - CASE WHEN l[-1] = '' THEN 1 ELSE 0 END AS n FROM cut),
drawn AS (SELECT *, CAST('0x' || d[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || d[9:16] AS BIGINT) % (n + 1) AS y,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || d[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
    WHEN CAST('0x' || d[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM sized),
ends AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b, list_transform(l, lambda e, i: e || CASE WHEN i < len(l) THEN chr(10) ELSE '' END) AS u FROM drawn),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM ends)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts""",
    "op13_spelling": r"""
WITH RECURSIVE found AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
runs AS (SELECT run, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM found WHERE length(run) >= 7),
bits AS (SELECT run, flatten(list_transform(range(0, length(x) // 2), lambda k: [CAST('0x' || substr(x, 2 * k + 1, 2) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])) AS b FROM runs),
signs AS (SELECT run, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, y: xor(xor(c, y) // 2, (xor(c, y) % 2) * 3988292384))) AS h FROM bits),
marked AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM signs),
words AS MATERIALIZED (SELECT word, count(*) AS n FROM marked WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
spots AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
cut AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM spots),
less AS (SELECT DISTINCT cut.word AS a, words.word AS b FROM cut JOIN words ON cut.rest = words.word),
pairs AS (SELECT x.word AS a, y.word AS b FROM cut x JOIN cut y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION ALL SELECT a, b FROM less UNION ALL SELECT b, a FROM less),
ranked AS (SELECT a, b, n AS b_n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k FROM pairs JOIN words ON b = word),
named AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN b_n >= 10 * n THEN b END AS form, CASE WHEN b_n >= 10 * n THEN b_n END AS form_n
  FROM words LEFT JOIN ranked ON a = word AND k = 1),
chains AS (SELECT word, word AS here, 0 AS step FROM named UNION ALL SELECT c.word, m.form, c.step + 1 FROM chains c JOIN named m ON c.here = m.word WHERE m.form IS NOT NULL),
roots AS (SELECT word, arg_max(here, step) AS root FROM chains GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM named JOIN roots USING (word)""",
}
