"""The operators applied to whole tables with production parameters, and their SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from weirgate.llm import (
    bpe, collocations, decontaminate, exact, jaccard, language, lines, merkle, mixing, pii, quality, repeats, shards)

VOCABULARY = "byte_bpe_50k.json"
SHARDS = 40
KEPT_SHARE = 0.5
SOURCE_WEIGHTS = [5.0, 2.0, 1.0]


def read(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard(spark, sf_dir):
    return jaccard.link(read(spark, sf_dir), width=3, percent=90)


def op2_line_dedup(spark, sf_dir):
    found = lines.remove_line_runs(read(spark, sf_dir))
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("kept", 256).alias("kept_sha256"))


def op2_line_dedup_content(spark, sf_dir):
    found = lines.remove_line_runs(read(spark, sf_dir), floor=lines.FLOOR)
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("kept", 256).alias("kept_sha256"))


def op3_decontamination(spark, sf_dir):
    return decontaminate.contaminated(read(spark, sf_dir), read(spark, sf_dir, "benchmark"))


def op4_language_id(spark, sf_dir):
    docs = read(spark, sf_dir)
    seen = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    found = language.predict(docs, language.fit(seen))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op5_personal_data(spark, sf_dir):
    return pii.digest(pii.find_spans(read(spark, sf_dir)))


def op6_rendezvous_shards(spark, sf_dir):
    return shards.shard_rows(read(spark, sf_dir), [1.0] * SHARDS)


def op7_suffix_dedup(spark, sf_dir):
    return repeats.remove_repeats(read(spark, sf_dir))


def op8_exact_dedup(spark, sf_dir):
    return exact.exact_groups(read(spark, sf_dir))


def op9_quality_resampling(spark, sf_dir):
    docs = read(spark, sf_dir)
    ratio = quality.fit(docs, quality.labelled(docs, read(spark, sf_dir, "labels")))
    return quality.resample(docs, ratio, KEPT_SHARE)


def op10_pareto_mix(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir), SOURCE_WEIGHTS).drop("copies")


def bpe_digests(docs: DataFrame, vocabulary: bpe.Vocabulary) -> DataFrame:
    """Numbers and digests of the token ids of each text, and of the text decoded from them."""
    coded = bpe.round_trip(docs, vocabulary)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2("packed", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op11_bpe_encoding(spark, sf_dir):
    import public_tokenizers
    return bpe_digests(read(spark, sf_dir), bpe.Vocabulary.load(public_tokenizers.path(VOCABULARY)))


def merkle_manifest(docs: DataFrame, tall: int = merkle.HEIGHT) -> DataFrame:
    """A manifest per language; a third of the rows are tampered with, by lower-casing their text."""
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"],
                           {"text": merkle.lower_ascii(F.col("text"))}, altered, tall=tall)


def op12_merkle_manifest(spark, sf_dir):
    return merkle_manifest(read(spark, sf_dir))


def op13_phrase_collocations(spark, sf_dir):
    return collocations.collocations(read(spark, sf_dir))


LLM_QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard, op2_line_dedup, op2_line_dedup_content, op3_decontamination, op4_language_id, op5_personal_data,
    op6_rendezvous_shards, op7_suffix_dedup, op8_exact_dedup, op9_quality_resampling, op10_pareto_mix,
    op11_bpe_encoding, op12_merkle_manifest, op13_phrase_collocations)}

OP2_SQL = """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS l, generate_subscripts(parts, 1) AS n FROM split),
runs AS (
  SELECT doc_id, n, l, lead(l, 1) OVER w AS l1, lead(l, 2) OVER w AS l2 FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
later AS (
  SELECT doc_id, n FROM runs WHERE l2 IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY l, l1, l2 ORDER BY doc_id, n) > 1),
gone AS (SELECT DISTINCT doc_id, n + k AS n FROM later, range(3) AS r(k)),
marked AS (SELECT lines.doc_id, lines.n, l, gone.n IS NOT NULL AS gone FROM lines LEFT JOIN gone USING (doc_id, n)),
begun AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY n), false) AS begins FROM marked)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_runs,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM begun GROUP BY doc_id
"""

OP2_CONTENT_SQL = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS l, generate_subscripts(parts, 1) AS n FROM split),
sized AS (SELECT *, octet_length(encode(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g'))) AS b FROM lines),
runs AS (
  SELECT doc_id, n, l, b, lead(l, 1) OVER w AS l1, lead(b, 1) OVER w AS b1, lead(l, 2) OVER w AS l2
  FROM sized WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
later AS (
  (SELECT doc_id, n, 1 AS size FROM runs WHERE b >= 16 QUALIFY row_number() OVER (PARTITION BY l ORDER BY doc_id, n) > 1)
  UNION ALL
  (SELECT doc_id, n, 2 AS size FROM runs WHERE l1 IS NOT NULL AND b + b1 >= 16
   QUALIFY row_number() OVER (PARTITION BY l, l1 ORDER BY doc_id, n) > 1)
  UNION ALL
  (SELECT doc_id, n, 3 AS size FROM runs WHERE l2 IS NOT NULL
   QUALIFY row_number() OVER (PARTITION BY l, l1, l2 ORDER BY doc_id, n) > 1)),
gone AS (SELECT DISTINCT doc_id, n + k AS n FROM later, range(3) AS r(k) WHERE k < size),
marked AS (SELECT lines.doc_id, lines.n, l, gone.n IS NOT NULL AS gone FROM lines LEFT JOIN gone USING (doc_id, n)),
begun AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY n), false) AS begins FROM marked)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_runs,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM begun GROUP BY doc_id
"""

OP6_SQL = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
docs AS (
  SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes
  FROM documents),
summed AS (
  SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, b:
    xor(c >> 8, step[(xor(c, b) & 255) + 1])))::BIGINT AS text_crc32
  FROM docs, crc),
raced AS (
  SELECT doc_id, shard, -ln((('0x' || substr(md5('shard' || shard || ':' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5::DOUBLE)
    / 281474976710656::DOUBLE) AS time
  FROM (SELECT DISTINCT doc_id FROM documents), range({SHARDS + 1}) AS s(shard)),
won AS (
  SELECT doc_id, arg_min(shard, (time, shard)) FILTER (shard < {SHARDS}) AS shard,
    arg_min(shard, (time, shard)) AS grown_shard
  FROM raced GROUP BY doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5('slot:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT,
    doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
  grown_shard::INTEGER AS grown_shard
FROM summed JOIN won USING (doc_id)
"""

OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""

OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, length(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn
  FROM sized GROUP BY source),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][turn % 3 + 1] AS weight FROM sources),
ordered AS (
  SELECT *, coalesce(sum(source_size) OVER w, 0)::BIGINT AS words, coalesce(sum(weight) OVER w, 0) AS used
  FROM weighed WINDOW w AS (ORDER BY source_size / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT - 2.0::DOUBLE * words) / (sum(weight) OVER () - used) AS level
  FROM ordered),
filled AS (SELECT *, level * weight >= 2.0::DOUBLE * source_size AS is_full FROM levels),
targets AS (
  SELECT source, source_size, turn, CASE WHEN is_full THEN 2.0::DOUBLE * source_size
    ELSE (SELECT arg_min(level, words) FROM filled WHERE NOT is_full) * weight END AS target
  FROM filled),
factors AS (
  SELECT sized.doc_id, sized.size, source_size, turn, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS factor,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || sized.size), 1, 12))::BIGINT + 0.5::DOUBLE)
      / 281474976710656::DOUBLE AS unit
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
odds AS (
  SELECT *, floor(factor) AS whole, target - floor(factor) * source_size AS need,
    (unit / (1 - unit)) / ((factor - floor(factor)) / (1 - (factor - floor(factor)))) AS ratio
  FROM factors),
ranked AS (
  SELECT *, least(floor(CASE WHEN factor > whole THEN ratio / (1 + ratio) ELSE unit END * 281474976710656::DOUBLE),
    281474976710655)::BIGINT AS place
  FROM odds),
summed AS (
  SELECT *, (sum(size) OVER (PARTITION BY turn ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS before
  FROM ranked)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN need > 0 AND (before + size <= need OR (before < need AND need - before >= size / 2.0::DOUBLE))
    THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed
"""

def _sized(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE octet_length(encode({column}::VARCHAR)) || ':' || {column}::VARCHAR END"


OP12_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
summed AS (
  SELECT documents.*, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
    doc_id IS NOT NULL AND xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(
      regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b:
      xor(c >> 8, step[(xor(c, b) & 255) + 1]))) % 3 = 0 AS altered
  FROM documents, crc),
digested AS (
  SELECT doc_id, lang, sha256({" || ".join(map(_sized, ["doc_id", "source", "lang", "n_chars", "text"]))}) AS leaf,
    CASE WHEN altered THEN sha256({" || ".join(map(_sized, ["doc_id", "source", "lang", "n_chars", "lowered"]))}) END AS changed
  FROM summed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    count(*) OVER (PARTITION BY lang) AS n FROM digested),
nodes AS (
  SELECT lang, 0 AS level, place, leaf AS digest, n FROM placed
  UNION ALL
  SELECT lang, level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (n + 7) // 8
  FROM nodes WHERE n > 1 GROUP BY lang, level, place // 8, n),
subroots AS (
  SELECT lang, digest AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, place, subroot AS digest, n FROM subroots
  UNION ALL
  SELECT level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (n + 7) // 8
  FROM tops WHERE n > 1 GROUP BY level, place // 8, n),
ways AS (
  SELECT doc_id, leaf, p.place AS row_place, p.lang, level, nodes.place AS place, nodes.place = p.place >> (3 * level) AS own, nodes.digest
  FROM placed AS p JOIN nodes ON p.lang IS NOT DISTINCT FROM nodes.lang AND nodes.n > 1 AND nodes.place >> 3 = p.place >> (3 * level + 3)
  UNION ALL
  SELECT doc_id, leaf, p.place, p.lang, height + level, tops.place, tops.place = s.place >> (3 * level), tops.digest
  FROM placed AS p JOIN subroots AS s ON p.lang IS NOT DISTINCT FROM s.lang
  JOIN tops ON tops.n > 1 AND tops.place >> 3 = s.place >> (3 * level + 3)),
proofs AS (
  SELECT row_place, lang, string_agg(digest, '' ORDER BY level, place) FILTER (NOT own) AS siblings FROM ways GROUP BY row_place, lang),
runs AS (
  SELECT row_place, lang, level, coalesce(string_agg(digest, '' ORDER BY place) FILTER (place < mine), '') AS ahead,
    coalesce(string_agg(digest, '' ORDER BY place) FILTER (place > mine), '') AS behind
  FROM (SELECT *, max(CASE WHEN own THEN place END) OVER (PARTITION BY row_place, lang, level) AS mine FROM ways)
  GROUP BY row_place, lang, level),
folds AS (
  SELECT lang, place AS row_place, 0 AS level, changed AS digest FROM placed WHERE changed IS NOT NULL
  UNION ALL
  SELECT f.lang, f.row_place, f.level + 1, sha256(r.ahead || f.digest || r.behind)
  FROM folds AS f JOIN runs AS r ON f.lang IS NOT DISTINCT FROM r.lang AND f.row_place = r.row_place AND f.level = r.level),
folded AS (SELECT lang, row_place, arg_max(digest, level) AS digest FROM folds GROUP BY lang, row_place),
result AS (
  SELECT p.doc_id, p.leaf, s.subroot, (SELECT digest FROM tops WHERE n = 1) AS root,
    sha256(coalesce(proofs.siblings, '')) AS proof_sha256, folded.digest
  FROM placed AS p JOIN subroots AS s ON p.lang IS NOT DISTINCT FROM s.lang
  LEFT JOIN proofs ON p.lang IS NOT DISTINCT FROM proofs.lang AND p.place = proofs.row_place
  LEFT JOIN folded ON p.lang IS NOT DISTINCT FROM folded.lang AND p.place = folded.row_place)
SELECT doc_id, leaf, subroot, root, proof_sha256, coalesce(digest, root) AS folded_root, coalesce(digest, root) = root AS verified
FROM result
"""

OP13_SQL = r"""
WITH split AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split(regexp_replace(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0B-\x0D]', chr(10), 'g'), chr(10))) AS piece
  FROM documents),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM split),
starts AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS s FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(words[s:s + k - 1], ' ') AS phrase, count(*) AS f
  FROM starts, range(1, 5) AS r(k) WHERE s + k - 1 <= len(words) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM grams WHERE k > 1 AND f >= 30),
frequent AS MATERIALIZED (SELECT lang, phrase, f FROM grams WHERE f >= 30),
parts AS (
  SELECT lang, phrase, a, c.cut AS cut, array_to_string(words[1:c.cut], ' ') AS head, array_to_string(words[c.cut + 1:], ' ') AS tail
  FROM candidates, range(1, 4) AS c(cut) WHERE c.cut < k),
headed AS (SELECT parts.*, frequent.f AS l FROM parts LEFT JOIN frequent ON parts.lang = frequent.lang AND head = frequent.phrase),
tailed AS (SELECT headed.*, frequent.f AS r FROM headed LEFT JOIN frequent ON headed.lang = frequent.lang AND tail = frequent.phrase),
cuts AS (SELECT lang, phrase, a, cut, l, r, (2000000::HUGEINT * a) // (l + r) AS score FROM tailed),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_phrases AS (
  SELECT lang, array_to_string(words[s.pos:s.pos + w.width - 1], ' ') AS phrase, max(a) AS longer
  FROM candidates, range(2, 4) AS w(width), range(1, 4) AS s(pos) WHERE w.width < k AND s.pos + w.width - 1 <= k GROUP BY ALL),
kept AS (
  SELECT weakest.* FROM weakest LEFT JOIN inner_phrases USING (lang, phrase)
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

LLM_SQL = {
    "op2_line_dedup": OP2_SQL, "op2_line_dedup_content": OP2_CONTENT_SQL,
    "op6_rendezvous_shards": OP6_SQL, "op8_exact_dedup": OP8_SQL, "op10_pareto_mix": OP10_SQL,
    "op12_merkle_manifest": OP12_SQL, "op13_phrase_collocations": OP13_SQL,
}
