"""The query of each operator with its production parameters, and the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, imatch, jaccard, lm, maxscore, mixing, pii, quality, substring, token_store, toxicity, variants

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff trigram scores of every document under the model of all others."""
    out = lm.backoff_scores(table(spark, sf_dir, "documents"), order=3, alpha=0.4)
    return out.withColumns({"log_score": F.round("log_score", 4), "mean_log_score": F.round("mean_log_score", 6)})


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all ids in doc_id order to directly addressable files and reads them back."""
    return token_store.read_tokens(spark, token_store.write_tokens(table(spark, sf_dir, "documents"), VOCABULARY, END_ID), digest=True)


def op6_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reading of every document when small sources repeat, twice at most."""
    return mixing.mix_report(table(spark, sf_dir, "documents"), repeats=2.0)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and the perplexity verdict of every document."""
    return quality.quality(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes words under windows of 13 words that start in an earlier document too."""
    return substring.substring_dedup(table(spark, sf_dir, "documents"), window=13, digest=True)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a model that never saw the held-out third."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all others."""
    vectors = table(spark, sf_dir, "embeddings").selectExpr("vec_id as id", "embedding as vector")
    return ann.search(vectors, lambda i: i % 20 == 0, k=20)


def op11_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    return imatch.fingerprints(table(spark, sf_dir, "documents"), low_idf=3.0, lexicon=500_000, least=8)


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of seven letters or more, their near words, and the frequent form each belongs to."""
    return variants.variants(table(spark, sf_dir, "documents"), least=7, often=2, every=31, times=10)


def op13_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents for each benchmark item."""
    return maxscore.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe_codec, op2_ngram_jaccard, op3_lm_scores, op4_pii, op5_token_store, op6_temperature_mix, op7_quality_rules, op8_substring_dedup, op9_toxicity, op10_multi_index, op11_imatch, op12_variants, op13_maxscore)}


_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 l AS MATERIALIZED (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id) p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.c >= 90 * (na.n + nb.n - p.c)),
 r(doc_id, k) AS (SELECT DISTINCT a, a FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.k),
 c AS (SELECT doc_id, min(k) AS component_id FROM r GROUP BY doc_id)
 SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id"""

LM_SQL = f"""WITH w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
 t AS (SELECT doc_id, unnest(ws) AS c, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM w),
 g AS (SELECT *, CASE WHEN i > 1 THEN lag(c, 1) OVER p END AS b, CASE WHEN i > 2 THEN lag(c, 2) OVER p END AS a FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
 k AS (SELECT *, count(*) OVER (PARTITION BY c) - count(*) OVER (PARTITION BY c, doc_id) AS f1, count(*) OVER (PARTITION BY b, c) - count(*) OVER (PARTITION BY b, c, doc_id) AS f2, count(*) OVER (PARTITION BY a, b, c) - count(*) OVER (PARTITION BY a, b, c, doc_id) AS f3, count(*) OVER () AS total FROM g),
 h AS (SELECT *, lag(f1) OVER p AS h1, lag(f2) OVER p AS h2 FROM k WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
 e AS (SELECT *, CASE WHEN a IS NOT NULL AND f3 > 0 THEN ln(f3 / h2) WHEN b IS NOT NULL AND f2 > 0 THEN ln(f2 / h1) + CASE WHEN a IS NOT NULL THEN ln(0.4) ELSE 0 END
 ELSE CASE WHEN f1 > 0 THEN ln(f1 / greatest(total - n, 1)) ELSE ln(0.4 / greatest(total - n, 1)) END + CASE WHEN a IS NOT NULL THEN 2 * ln(0.4) WHEN b IS NOT NULL THEN ln(0.4) ELSE 0 END END AS s FROM h)
 SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, round(coalesce(sum(s), 0.0), 4) AS log_score, round(sum(s) / len(ws), 6) AS mean_log_score FROM w LEFT JOIN e ON e.doc_id = w.doc_id GROUP BY w.doc_id, len(ws)"""

SUBSTRING_SQL = f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
 x AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
 f AS (SELECT g, min(doc_id) AS d FROM x GROUP BY g),
 c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM x JOIN f ON f.g = x.g WHERE d < doc_id),
 k AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
 o AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.p) AS kept FROM k LEFT JOIN c ON c.doc_id = k.doc_id AND c.p = k.p WHERE c.p IS NULL GROUP BY k.doc_id),
 m AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
 SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(m.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN o ON o.doc_id = w.doc_id LEFT JOIN m ON m.doc_id = w.doc_id"""


IMATCH_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 e AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS x FROM d),
 f AS (SELECT doc_id, n, t, concat(substr(t, 1, n - n // 4), substr(x, 1, n // 4)) AS u FROM e),
 s AS (SELECT doc_id, 0 AS side, t FROM f UNION ALL SELECT doc_id, 1, u FROM f),
 w AS (SELECT doc_id, side, list_transform(list_distinct(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), lambda w: CAST('0x' || substr(md5(w), 1, 15) AS BIGINT)) AS ts FROM s),
 c AS (SELECT h, count(*) AS df FROM (SELECT unnest(ts) AS h FROM w WHERE side = 0) GROUP BY h),
 b AS (SELECT h, df FROM c WHERE df >= 2 AND df <= greatest(2.0, (SELECT count(*) FROM d) / exp(3.0))),
 q AS (SELECT k, (SELECT count(*) FROM b WHERE df >= CAST(1 AS BIGINT) << CAST(k - 1 AS INTEGER)) AS terms FROM range(2, 40) r(k)),
 lexicon AS (SELECT h FROM b WHERE df >= (SELECT CAST(1 AS BIGINT) << CAST(min(k) - 1 AS INTEGER) FROM q WHERE terms <= 500000)),
 l AS (SELECT *, greatest(6, CASE WHEN len(ts) > 1 THEN length(bin(len(ts) - 1)) ELSE 1 END) AS level FROM w),
 g AS (SELECT doc_id, side, level, h FROM (SELECT doc_id, side, level, unnest(ts) AS h FROM l) WHERE h & ((CAST(1 AS BIGINT) << level) - 1) < 64),
 k AS (SELECT g.*, lexicon.h IS NOT NULL AS known FROM g LEFT JOIN lexicon ON lexicon.h = g.h),
 m AS (SELECT doc_id, side, level + up AS level, h, band FROM k, (VALUES (0), (1)) u(up), (VALUES (true), (false)) v(band) WHERE (up = 0 OR h & (CAST(1 AS BIGINT) << level) = 0) AND (known OR NOT band)),
 n AS (SELECT doc_id, side, band, printf('%02X', level) || printf('%02X', h & 63) AS place, substr(md5(string_agg(CAST(h AS VARCHAR), ' ' ORDER BY h)), 1, 4) AS hashed FROM m GROUP BY doc_id, side, band, place),
 o AS (SELECT doc_id, side, coalesce(list(place || hashed ORDER BY place) FILTER (band), []) AS banded, coalesce(list(place || hashed ORDER BY place) FILTER (NOT band), []) AS every FROM n GROUP BY doc_id, side),
 p AS (SELECT l.doc_id, l.side, coalesce(banded, []) AS banded, coalesce(every, []) AS every FROM l LEFT JOIN o ON o.doc_id = l.doc_id AND o.side = l.side),
 h AS (SELECT *, array_to_string(banded, '') || '|' || array_to_string(every, '') AS fp FROM p),
 y AS (SELECT doc_id, side, banded, every, fp, coalesce(lead(banded) OVER o, first_value(banded) OVER o) AS b2, coalesce(lead(every) OVER o, first_value(every) OVER o) AS e2, coalesce(lead(fp) OVER o, first_value(fp) OVER o) AS f2 FROM h WHERE side = 0 WINDOW o AS (ORDER BY doc_id)),
 z AS (SELECT doc_id, 'next' AS what, fp = f2 AS same, CASE WHEN len(banded) >= 8 AND len(b2) >= 8 THEN banded ELSE every END AS x, CASE WHEN len(banded) >= 8 AND len(b2) >= 8 THEN b2 ELSE e2 END AS y FROM y
 UNION ALL SELECT i.doc_id, 'edited', i.fp = j.fp, CASE WHEN len(i.banded) >= 8 AND len(j.banded) >= 8 THEN i.banded ELSE i.every END, CASE WHEN len(i.banded) >= 8 AND len(j.banded) >= 8 THEN j.banded ELSE j.every END FROM h i JOIN h j ON j.doc_id = i.doc_id AND i.side = 0 AND j.side = 1),
 a AS (SELECT *, list_intersect(list_transform(x, lambda e: substr(e, 1, 2)), list_transform(y, lambda e: substr(e, 1, 2))) AS levels FROM z),
 r AS (SELECT doc_id, what, same, len(list_intersect(x, y)) AS hit, len(list_distinct(list_transform(list_filter(list_concat(x, y), lambda e: list_contains(levels, substr(e, 1, 2))), lambda e: substr(e, 1, 4)))) AS places FROM a),
 v AS (SELECT doc_id, what, CASE WHEN same THEN 1.0 WHEN places > 0 THEN hit / places ELSE 0.0 END AS near FROM r)
 SELECT f.doc_id, CAST(f.n AS BIGINT) AS n_chars, sha256(f.u) AS edited_sha256, i.fp AS fingerprint, j.fp AS edited_fingerprint, CAST(ve.near AS DOUBLE) AS near_edited, CAST(vn.near AS DOUBLE) AS near_next
 FROM f JOIN h i ON i.doc_id = f.doc_id AND i.side = 0 JOIN h j ON j.doc_id = f.doc_id AND j.side = 1 JOIN v ve ON ve.doc_id = f.doc_id AND ve.what = 'edited' JOIN v vn ON vn.doc_id = f.doc_id AND vn.what = 'next'"""


#: DuckDB has no crc32: it is folded over the hexadecimal digits of the UTF-8 bytes, low digit first, with its table of 16.
VARIANTS_SQL = f"""WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),
 c AS (SELECT doc_id, run, count(*) AS n, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS x FROM r WHERE length(run) >= 7 GROUP BY doc_id, run),
 h AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(x)), lambda i: CAST(instr('0123456789ABCDEF', substr(x, CAST(xor(i, 1) + 1 AS INTEGER), 1)) - 1 AS BIGINT))),
 lambda a, d: xor(a >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][(xor(a, d) & 15) + 1])), 4294967295) AS h FROM c),
 v AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM h),
 w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
 d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, CAST(unnest(range(length(word))) AS INTEGER) AS i FROM w)),
 p AS (SELECT a.word, b.word AS other, a.n, b.n AS m FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word)
 UNION SELECT w.word, d.word, w.n, d.n FROM w JOIN d ON d.rest = w.word UNION SELECT d.word, w.word, d.n, w.n FROM w JOIN d ON d.rest = w.word),
 o AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS k FROM p),
 f AS (SELECT word, n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM o WHERE k = 1),
 t(word, root) AS (SELECT word, form FROM f WHERE form IS NOT NULL UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.root WHERE f.form IS NOT NULL),
 e AS (SELECT t.word, t.root FROM t JOIN f ON f.word = t.root WHERE f.form IS NULL)
 SELECT w.word, form, coalesce(root, w.word) AS root, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM w LEFT JOIN f ON f.word = w.word LEFT JOIN e ON e.word = w.word"""


_TERMS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
MAXSCORE_SQL = f"""WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
 s AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(ts)) AS BIGINT) AS l FROM d WHERE len(ts) > 0),
 t AS (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf, any_value(size) AS size FROM (SELECT doc_id, CAST(len(ts) AS BIGINT) AS size, unnest(ts) AS term FROM d) GROUP BY doc_id, term),
 w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * s.n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, CAST(count(*) AS BIGINT) AS df FROM t GROUP BY term), s),
 q AS (SELECT item_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
 r AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * size * s.n) // s.l)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN t USING (term), s GROUP BY item_id, doc_id),
 k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
 SELECT * FROM k WHERE rank <= 10"""


def oracle_sql() -> dict[str, str]:
    """What DuckDB can say. Not: library encodings (1, 5), look-around patterns (4), Spark's hash (6), trained models (7, 9), an approximate index (10)."""
    return {"op2_ngram_jaccard": JACCARD_SQL, "op3_lm_scores": LM_SQL, "op8_substring_dedup": SUBSTRING_SQL, "op11_imatch": IMATCH_SQL, "op12_variants": VARIANTS_SQL, "op13_maxscore": MAXSCORE_SQL}
