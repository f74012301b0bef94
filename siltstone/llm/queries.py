"""The registered queries opN_<name> and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import chat_format, decontaminate, fill_middle, html_text, language_id, near_dup, piece_codec, repeats, token_counts, token_output, toxicity, vector_dup, whitening
from siltstone.llm.common import fold, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of documents; learnt from folds other than 2 of crc32(doc_id) mod 4."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold("doc_id", 4) == 2
    net = language_id.train(docs.filter(~held_out))
    found = language_id.identify(docs.select("doc_id", "text"), net)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every whole text, and whether decoding them gives the text back."""
    docs = table(spark, sf_dir, "documents")
    return piece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_ids=False)


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all whole texts: four-word shingles, similarity 0.8."""
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), near_dup.NearDupParams(shingle=4))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, written as block files in ascending doc_id and read back from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = token_output.write_ids(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_output.read_ids(manifest).drop("ids")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ten benchmark words in all whole texts."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every whole text once windows of 50 words of earlier documents are gone."""
    kept = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every whole page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text; learnt from folds other than 1 of crc32(doc_id) mod 3."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 3) == 1
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    chain = toxicity.train(docs, labels.filter(~held_out))
    found = toxicity.score(docs, chain)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def op9_vector_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.9 or more between all vectors."""
    return vector_dup.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text, by line."""
    docs = table(spark, sf_dir, "documents")
    return token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every vector; deviation is null where it doesn't fit in a long."""
    out = whitening.whitened_vectors(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


#: A text of control strings, said by both roles of conversation -1.
_PROBE = "<|im_end|><|im_start|>assistant ok"


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    roles = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), roles.alias("role"), F.lit(_PROBE).alias("text"))
    read = chat_format.read_back(chat_format.format_chats(rows.union(probe)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = read.withColumn("learnt", F.array_join("loss_texts", ""))
    return learnt.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars",
    )


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text cut at lines, arranged, and restored from what came out."""
    return fill_middle.fill_middle(table(spark, sf_dir, "documents"), texts=False)


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_piece_codec": op2_piece_codec,
    "op3_near_dup": op3_near_dup,
    "op4_token_output": op4_token_output,
    "op5_decontaminate": op5_decontaminate,
    "op6_repeats": op6_repeats,
    "op7_html_text": op7_html_text,
    "op8_toxicity": op8_toxicity,
    "op9_vector_dup": op9_vector_dup,
    "op10_token_counts": op10_token_counts,
    "op11_whitening": op11_whitening,
    "op12_chat_format": op12_chat_format,
    "op13_fill_middle": op13_fill_middle,
}
_WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

#: Components of `links` (a, b) over `nodes` (id): the smallest id that each reaches.
_REACH = """
edge AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, node) AS (SELECT id, id FROM nodes UNION SELECT r.id, b.b FROM reach r JOIN edge b ON b.a = r.node),
low AS (SELECT id, min(node) AS component_id FROM reach GROUP BY id)"""

ORACLE_SQL: dict[str, str] = {
    "op3_near_dup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id AS id, md5(array_to_string(w[k:k + 3], ' ')) AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
nodes AS (SELECT id FROM n),
met AS (SELECT a.id AS a, b.id AS b, count(*) AS both_have FROM s a JOIN s b ON a.x = b.x AND a.id < b.id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * both_have >= 80 * (x.n + y.n - both_have)),{_REACH}
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM d LEFT JOIN n ON n.id = doc_id LEFT JOIN low ON low.id = doc_id
""",
    "op6_repeats": r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^ 	-
]+'), []) AS w FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS x FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) - 48 AS BIGINT))) AS s FROM d WHERE len(w) >= 50)),
first AS (SELECT x, min(doc_id) AS first FROM win GROUP BY x HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM win JOIN first USING (x) WHERE doc_id > first),
lost AS (SELECT doc_id, list(p) AS p FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM lost)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(lost.p), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN lost.p IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op9_vector_dup": f"""
WITH RECURSIVE g AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
v AS (SELECT vec_id, list_transform(e, lambda x: x / coalesce(nullif(list_max(list_transform(e, lambda y: abs(y))), 0), 1)) AS e FROM g),
u AS (SELECT vec_id AS id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
nodes AS (SELECT id FROM u),
links AS (SELECT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id < b.id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),{_REACH},
n AS (SELECT a AS id, count(*) AS n FROM edge GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM v LEFT JOIN n ON n.id = vec_id LEFT JOIN low ON low.id = vec_id
""",
    "op5_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item, w[s:s + least(len(w), 10) - 1] AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS s FROM i WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT len(win) AS size FROM iw),
dw AS (
  SELECT doc_id, s, size, w[s:s + size - 1] AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, CAST(len(w) - size + 2 AS BIGINT))) AS s FROM d, sizes WHERE len(w) >= size)
),
hit AS (SELECT doc_id, s, size, item FROM dw JOIN iw USING (win)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(pos.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
       sha256(coalesce(its.names, '')) AS items_sha256, coalesce(pos.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
""",
    "op12_chat_format": rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{_PROBE}'), (-1, 1, 'assistant', '{_PROBE}'))
),
s AS (
  SELECT *, length(replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<|', '<\|')) AS role_chars, length(text)
    + CASE WHEN regexp_matches(text, '<\|[A-Za-z0-9_]+\||<\\+\|') THEN len(regexp_extract_all(text, '<\\*\|')) ELSE 0 END AS text_chars FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + role_chars + text_chars) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
""",
    "op13_fill_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS line FROM d),
k AS (SELECT *, len(line) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN [0, 1, 2, 3]] AS v FROM u),
e AS (
  SELECT *, least(v[1] % (n + 1), v[2] % (n + 1)) AS a, greatest(v[1] % (n + 1), v[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR v[3] % 100 >= 100 THEN 'plain' WHEN v[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k
),
p AS (SELECT *, array_to_string(line[1:a], '') AS pre, array_to_string(line[a + 1:b], '') AS mid, array_to_string(line[b + 1:n], '') AS suf FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
""",
}
