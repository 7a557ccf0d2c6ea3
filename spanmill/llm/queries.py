"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.llm import chat, codes, fixity, fracsketch, imi, infill, licenses, minhash, packing, pii, spm, suffix, toxicity
from spanmill.llm.common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, pii.session_key(spark), kinds="kinds").withColumn("n_private", F.size("kinds").cast("long"))


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imi.search(table(spark, sf_dir, "embeddings"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("int").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn int, role string, text string")
    return chat.digests(chat.format_conversations(turns.unionByName(probe)))


def op4_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), with_ids=False)


def op6_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op7_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit_chain(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs.select("doc_id", "text"), chain)
    return scored.select("doc_id", "p_quality", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"))


def op8_threshold_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fracsketch.compare_with_edit(table(spark, sf_dir, "documents"))


def op9_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return fixity.audit(fixity.leaves(pages), fixity.leaves(fixity.damaged_copy(pages)))


def op10_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op11_infill_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    back = F.sha2(infill.restored(F.col("output"), F.col("form")), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), back.alias("restored_sha256"))


def op12_annular_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op13_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii_feistel, op2_multi_index, op3_chat_format, op4_license_rules, op5_sentencepiece, op6_circulant_minhash,
        op7_classifier_chain, op8_threshold_sketch, op9_merkle_fixity, op10_bin_slack, op11_infill_checkpoints,
        op12_annular_codes, op13_suffix_arrays, pipeline,
    )
}

_FORMATTED = r"""
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(length(regexp_replace(regexp_replace(text, '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\]|NEXT\])', '[\\\1\2', 'g')))
    + sum(CASE WHEN role = before THEN 6 ELSE 20 + length(role) END))::BIGINT AS formatted_chars,
  (sum(CASE WHEN role = before THEN 0 ELSE 1 END))::BIGINT AS n_blocks
FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'))
GROUP BY conv_id"""


def _license_sql() -> str:
    ids = licenses.known_parts()
    values = ", ".join(f"('{p}', {i})" for p, i in ids.items() if "{" not in p)
    slots = " ".join(f"WHEN regexp_full_match(sentence, '{licenses.as_pattern(p)}') THEN {i}" for p, i in ids.items() if "{" in p)
    rules = licenses.rule_sequences()
    listed = ", ".join(f"('{r}', '{name}', {seq})" for r, (name, seq) in rules.items())
    return rf"""
WITH known(sentence, id) AS (VALUES {values}), rules(rule_id, license_id, seq) AS (VALUES {listed}),
cut AS (SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS i FROM (
  SELECT doc_id, string_split_regex(regexp_replace(text, '(https?://\S+)\s', '\1' || chr(10), 'g'), '\s*(?:[.!?:]+\s+|\n)\s*') AS p FROM documents WHERE text IS NOT NULL)),
parts AS (SELECT doc_id, i, trim(regexp_replace(lower(part), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS sentence FROM cut),
named AS (SELECT doc_id, i, sentence, lag(sentence) OVER (PARTITION BY doc_id ORDER BY i) = '{licenses.LINE}' AND regexp_full_match(sentence, '{licenses.expression_pattern()}') AS several FROM parts),
names AS (SELECT doc_id, i, unnest(n) AS sentence, generate_subscripts(n, 1) AS k FROM (SELECT doc_id, i, regexp_extract_all(' ' || sentence, ' ({licenses.spdx_names()})', 1) AS n FROM named WHERE several)),
slotted AS (SELECT doc_id, i, CASE {slots} END AS id FROM named ANTI JOIN known USING (sentence)),
each AS (SELECT doc_id, i, 1 AS k, id FROM named JOIN known USING (sentence) WHERE several IS NOT TRUE UNION ALL SELECT doc_id, i, 1, id FROM slotted WHERE id IS NOT NULL
  UNION ALL SELECT doc_id, i, 2 * k, id FROM names JOIN known USING (sentence) UNION ALL SELECT doc_id, i, 2 * k - 1, {ids[licenses.LINE]} FROM names JOIN known USING (sentence) WHERE k > 1),
found AS (SELECT doc_id, list(id ORDER BY i, k) AS ids FROM each GROUP BY doc_id),
every AS (SELECT doc_id, license_id, rule_id, (pos - 1)::BIGINT AS place, len(seq)::BIGINT AS n_sentences
  FROM (SELECT doc_id, ids, unnest(range(1, len(ids) + 1)) AS pos FROM found), rules WHERE list_slice(ids, pos, pos + len(seq) - 1) = seq)
SELECT * FROM every m WHERE NOT EXISTS (SELECT 1 FROM every o WHERE o.doc_id = m.doc_id AND o.n_sentences > m.n_sentences
  AND o.place <= m.place AND m.place + m.n_sentences <= o.place + o.n_sentences)"""


_RECORD = r"""'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>'
  || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
  || 'Content-Length: ' || strlen(BODY)::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10) || BODY || chr(13) || chr(10) || chr(13) || chr(10)"""
_FIXITY = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
q AS (SELECT *, CASE WHEN page_id % 97 = 13 THEN CASE WHEN html = '' THEN 'x' ELSE (CASE WHEN html[1] = 'x' THEN 'y' ELSE 'x' END) || substr(html, 2) END
  WHEN page_id % 389 = 7 THEN left(html, length(html) // 2) ELSE html END AS other FROM p),
r AS (SELECT page_id, page_id // {fixity.RECORDS_PER_FILE} AS warc, {_RECORD.replace('BODY', 'html')} AS a, {_RECORD.replace('BODY', 'other')} AS b FROM q),
s AS (SELECT *, sum(strlen(a)) OVER w AS stop, row_number() OVER w - 1 AS place FROM r WINDOW w AS (PARTITION BY warc ORDER BY page_id ROWS UNBOUNDED PRECEDING))
SELECT warc::BIGINT AS warc, place, page_id, (stop - strlen(a))::BIGINT AS start, stop::BIGINT AS stop, sha256(a) AS expected, sha256(b) AS found, 'altered' AS damage
FROM s WHERE a <> b"""

_INFILL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, text, h, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM d),
c AS (SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
    WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, n, form, array_to_string(units[1:least(a, b)], '') AS prefix, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle,
  array_to_string(units[greatest(a, b) + 1:], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""


def _codes_sql() -> str:
    """The rounds written out one after another."""
    near = """(SELECT key, part, v, label, vec_id, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d FROM (
  SELECT x.*, entry, (v[1] - e[1]) ** 2 + (v[2] - e[2]) ** 2 + (v[3] - e[3]) ** 2 + (v[4] - e[4]) ** 2 + (v[5] - e[5]) ** 2 + (v[6] - e[6]) ** 2 + (v[7] - e[7]) ** 2 + (v[8] - e[8]) ** 2 AS d
  FROM parts x JOIN {book} USING (part)) GROUP BY ALL)"""
    rounds, book = [], "book0"
    means = ", ".join(f"floor(sum(v[{i}]) / count(*))::BIGINT" for i in range(1, 9))
    for k in range(1, codes.ROUNDS + 1):
        rounds.append(f"""book{k} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.e, b.e) AS e FROM {book} b
  LEFT JOIN (SELECT part, entry, [{means}] AS e FROM {near.format(book=book)} GROUP BY part, entry) m ON m.part = b.part AND m.entry = b.entry)""")
        book = f"book{k}"
    return f"""
WITH whole AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS key, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS MATERIALIZED (SELECT key, vec_id, label, part, list_slice(w, 8 * part + 1, 8 * part + 8) AS v FROM whole, (SELECT unnest(range(8)) AS part)),
book0 AS MATERIALIZED (SELECT part, key - 1 AS entry, v AS e FROM parts WHERE key <= 16),
{', '.join(rounds)},
coded AS (SELECT key, vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM {near.format(book=book)} GROUP BY ALL)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  sha256((SELECT string_agg(array_to_string(e, ','), ',' ORDER BY part, entry) FROM {book})) AS codebooks_sha256 FROM coded"""


ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": _FORMATTED,
    "op4_license_rules": _license_sql(),
    "op9_merkle_fixity": _FIXITY,
    "op11_infill_checkpoints": _INFILL,
    "op12_annular_codes": _codes_sql(),
}
