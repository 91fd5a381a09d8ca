"""Registered queries of this package and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codehealth.llm import byte_cnn, hash_tree, itemset_counting, line_dedup, norm_topk, prefix_bpe, secret_battery, simhash_blocks, token_orc, turn_alignment, url_lm, warc_normaliser, winnowing
from codehealth.llm.common import shared_path, table

SHARDS = 40


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.deduplicate(docs)
    cut = F.coalesce("line_cut", F.array().cast("array<int>"))
    return out.select("doc_id", F.size(cut).cast("long").alias("n_removed"), cut.alias("removed_lines"), "text")


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-orc")
    token_orc.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_orc.token_index(spark, path)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lm.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.shard(table(spark, sf_dir, "documents"), hash_tree.Tree(SHARDS), hash_tree.Tree(SHARDS + 1))


def bpe_digest(docs: DataFrame) -> DataFrame:
    out = prefix_bpe.encode_and_decode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"))


def op6_norm_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = norm_topk.quantised(table(spark, sf_dir, "embeddings"))
    return norm_topk.top_k(vectors, F.col("vec_id") % 50 == 0)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_blocks.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash_blocks.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_battery.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter(spans, lambda s: s["kind"] != "random")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
                      listed(spans).alias("spans"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = byte_cnn.identify(docs.select("doc_id", "text"), byte_cnn.fit(docs))
    return out.select("doc_id", byte_cnn.held_out(F.col("doc_id")).alias("held_out"), F.col("lang_id.lang").alias("lang_pred"), F.col("lang_id.score").alias("score"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnowing.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op11_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc_normaliser.stored_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_turn_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return turn_alignment.repair(turn_alignment.damage(turns), every=turns)


def op13_itemset_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itemset_counting.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_line_dedup, op2_token_orc, op3_url_filter, op4_hash_tree, op5_prefix_bpe, op6_norm_topk, op7_simhash, op8_secret_scan,
    op9_language_id, op10_decontaminate, op11_warc_normaliser, op12_turn_alignment, op13_itemset_counting)}

ORACLE: dict[str, str] = {
    "op6_norm_topk": """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op10_decontaminate": r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS run
  FROM iw, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS u(s) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM windows),
dwin AS (
  SELECT r, doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS run
  FROM dw, lengths, unnest(generate_series(1, len(w) - n + 1)) AS u(s)),
met AS (SELECT d.r, d.n, d.s, i.item_id FROM dwin d JOIN windows i ON d.n = i.n AND d.run = i.run),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(s, s + n - 1)) AS p FROM met) GROUP BY r),
ids AS (SELECT r, list_sort(list(DISTINCT item_id)) AS items FROM met GROUP BY r)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit ON dw.r = hit.r LEFT JOIN ids ON dw.r = ids.r""",
    "op11_warc_normaliser": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS b, sha256(coalesce(html, '')) AS d FROM pages),
r AS (
  SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS kept FROM p
  WINDOW w AS (PARTITION BY d ORDER BY page_id NULLS LAST))
SELECT page_id, CAST(b AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN b < 100 OR place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN b < 100 OR place = 1 THEN NULL ELSE kept END AS refers_to
FROM r""",
    "op12_turn_alignment": r"""
WITH RECURSIVE src AS (
  SELECT row_number() OVER () AS id, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS spot FROM conversations),
coded AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(spot, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b:
    list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x // 2, 3988292384::BIGINT * (x % 2)))), 4294967295::BIGINT) % 20 AS k
  FROM src),
hurt AS (
  SELECT id, conv_id, turn, CASE k WHEN 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE k WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM coded WHERE k <> 0),
flags AS (
  SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 16), md5(text), id, copy) AS pos FROM hurt),
turns AS (
  SELECT *, shown = '' AS blank,
         shown <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS duplicate FROM flags),
rows_ AS (
  SELECT *, NOT blank AND NOT duplicate AND right(shown, 1) NOT IN ('.', '!', '?') AS truncated, left(role, 1) AS initial FROM turns),
convs AS (SELECT DISTINCT conv_id FROM conversations),
moves(st, as_role, letters, cost, nxt) AS (VALUES
  ('^', 's', '', 0, 's'), ('^', 'u', '', 0, 'a'), ('s', 'u', '', 0, 'a'), ('u', 'u', '', 0, 'a'), ('a', 'a', '', 0, 'u'),
  ('^', 'a', 'I', 3, 'u'), ('s', 'a', 'I', 3, 'u'), ('u', 'a', 'I', 3, 'u'), ('a', 'u', 'I', 3, 'a'),
  ('^', 'D', '', 4, '^'), ('s', 'D', '', 4, 's'), ('u', 'D', '', 4, 'u'), ('a', 'D', '', 4, 'a')),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, '^' AS st, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS parts FROM convs
  UNION ALL
  SELECT conv_id, i, st, cost, audit, parts FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, st ORDER BY cost, audit) AS best FROM (
      SELECT d.conv_id, d.i + 1 AS i, m.nxt AS st,
             d.cost + m.cost + CASE WHEN m.as_role = 'D' THEN 0 ELSE CASE WHEN r.initial = m.as_role THEN 0 ELSE 3 END + CASE WHEN r.truncated THEN 3 ELSE 0 END END AS cost,
             d.audit || m.letters || CASE WHEN m.as_role = 'D' THEN 'D' WHEN r.initial = m.as_role THEN 'K' ELSE 'R' END AS audit,
             list_concat(d.parts,
               CASE WHEN m.letters = 'I' THEN [CASE m.as_role WHEN 'a' THEN 'user:' ELSE 'assistant:' END] ELSE [] END,
               CASE WHEN m.as_role = 'D' THEN [] WHEN r.initial = m.as_role THEN [r.role || ':' || r.text]
                    ELSE [CASE m.as_role WHEN 'a' THEN 'assistant' ELSE 'user' END || ':' || r.text] END) AS parts
      FROM dp d JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.pos = d.i + 1
      JOIN moves m ON m.st = d.st
        AND (m.as_role = 'D' OR (NOT r.blank AND NOT r.duplicate AND (m.as_role <> 's' OR r.initial = 's'))))) WHERE best = 1),
facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated
  FROM rows_ GROUP BY conv_id),
pairs AS (SELECT conv_id, initial, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM rows_),
illegal AS (SELECT conv_id, count(*) AS illegal FROM pairs WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au') GROUP BY conv_id),
ends(st, cost, letters, parts) AS (VALUES
  ('^', 0, '', []::VARCHAR[]), ('u', 0, '', []), ('a', 3, 'I', ['assistant:']), ('s', 6, 'II', ['user:', 'assistant:'])),
done AS (
  SELECT c.conv_id, coalesce(f.n, 0) AS n, d.cost + e.cost AS cost, d.audit || e.letters AS audit, list_concat(d.parts, e.parts) AS parts,
         row_number() OVER (PARTITION BY c.conv_id ORDER BY d.cost + e.cost, d.audit || e.letters) AS best
  FROM convs c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
  JOIN dp d ON d.conv_id IS NOT DISTINCT FROM c.conv_id AND d.i = coalesce(f.n, 0) JOIN ends e ON e.st = d.st)
SELECT d.conv_id, CAST(coalesce(f.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(f.blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(f.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(f.truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(g.illegal, 0) AS BIGINT) AS illegal, CAST(d.cost AS BIGINT) AS cost, d.audit,
       sha256(coalesce(array_to_string(d.parts, chr(10)), '')) AS repaired_sha256
FROM done d LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN illegal g ON g.conv_id IS NOT DISTINCT FROM d.conv_id
WHERE d.best = 1""",
    "op13_itemset_counting": r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, list_filter(string_split_regex(unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda x: x <> '') AS w FROM docs),
grams AS (
  SELECT lang, k, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda s: array_to_string(w[s:s + k - 1], ' '))) AS phrase
  FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS total FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 100),
inside AS (
  SELECT lang, phrase, max(n) AS more FROM (
    SELECT lang, n, unnest(list_transform(generate_series(1, k - m + 1), lambda s: array_to_string(w[s:s + m - 1], ' '))) AS phrase
    FROM cand, (SELECT unnest([2, 3, 4]) AS m) WHERE m < k) GROUP BY ALL),
often AS (SELECT * FROM f WHERE n >= 100),
kept AS (SELECT c.* FROM cand c LEFT JOIN inside i ON c.lang = i.lang AND c.phrase = i.phrase WHERE i.more IS NULL OR 100 * i.more < 100 * c.n),
split AS (SELECT *, unnest(generate_series(1, k - 1)) AS cut FROM kept),
cuts AS (
  SELECT c.lang, c.phrase, c.n AS a, cut, l.n AS l, r.n AS r, t.total AS n,
         CAST((1000::HUGEINT * c.n * t.total) // (l.n::HUGEINT * r.n) AS BIGINT) AS score
  FROM split c JOIN often l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN often r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:], ' ') JOIN totals t ON t.lang = c.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS b FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best WHERE b = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
FROM ranked WHERE rank <= 2000""",
}
