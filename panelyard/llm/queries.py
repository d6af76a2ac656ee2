"""The registered query of each operator, with its SQL check where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm import aho_search, chat_format, chunk_recipes, fact_machine, fm_substrings, gru_toxicity, huffman_ids, metric_join, mixing, token_alignment, url_filter, wrapper_text, wu_manber
from panelyard.llm.common import table
from panelyard.session import cut_lineage, scratch_path

QUERIES, CHECKS = {}, {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            CHECKS[fn.__name__] = sql
        return fn

    return register


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def id_files(spark, docs: DataFrame) -> DataFrame:
    """Writes the ids of ``docs`` as files and gives each document's digest from what the files hold."""
    path = scratch_path(spark, "ids")
    huffman_ids.write_ids(docs, path, tokenizer_path(), end_id=2)
    return huffman_ids.read_ids(spark, path, ids=False)


@query()
def op1_huffman_ids(spark, sf_dir):
    return id_files(spark, table(spark, sf_dir, "documents"))


_WORDS = "list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), lambda x: x <> '')"


@query(f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
g AS (SELECT item, least(len(w), 13) AS m, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i, w FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item, m, w[i:i + m - 1] AS s FROM g),
sizes AS (SELECT DISTINCT m FROM p),
x AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i, w FROM d, sizes WHERE len(w) >= m),
h AS (SELECT doc_id, i, x.m, item FROM x JOIN p ON x.m = p.m AND w[i:i + x.m - 1] = s),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)""")
def op2_wu_manber(spark, sf_dir):
    out = wu_manber.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("items", "spans")


@query("""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM x GROUP BY h),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM x JOIN f USING (h) WHERE first < doc_id),
e AS (SELECT doc_id, w[k] AS word, k FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
r AS (SELECT e.doc_id, count(g.k) AS n_removed, string_agg(CASE WHEN g.k IS NULL THEN word END, ' ' ORDER BY e.k) AS kept
  FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.k = g.k GROUP BY e.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)""")
def op6_fm_substrings(spark, sf_dir):
    return fm_substrings.repeated_words(table(spark, sf_dir, "documents")).drop("kept")


@query("""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
  CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15)) AS BIGINT) AS h FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0e0, 1.0e0, 2.0e0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight, source_size * 2.0e0 AS bound FROM p),
r AS (SELECT *, bound / weight AS fill, row_number() OVER (ORDER BY bound / weight, source IS NULL, source) AS k FROM w),
l AS (SELECT *, ((SELECT CAST(sum(source_size) AS DOUBLE) FROM r) * 1.5e0
  - coalesce(sum(bound) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0)) / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, least(bound, (SELECT min_by(level, k) FROM l WHERE level <= fill) * weight) AS target FROM l),
c AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
v AS (SELECT d.doc_id, d.size, c.source_size, c.target, c.copies, c.target - c.copies * c.source_size AS rest,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(d.size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
 CAST((copies + CASE WHEN upto <= rest OR (upto - own <= rest AND upto - rest < rest - (upto - own)) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM v""")
def op7_hash_threshold_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.other = e.x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)""")
def op3_metric_jaccard_join(spark, sf_dir):
    return metric_join.jaccard_components(table(spark, sf_dir, "documents"))


def fold(doc_id="doc_id", of=3):
    """crc32 of the id as text, modulo ``of``; a null id is the text "null"."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary")) % of


@query()
def op4_factorisation_machine(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fact_machine.train(fact_machine.sample(docs, labels.where(fold(of=3) != 1)))
    out = fact_machine.score(docs, model)
    return out.select("doc_id", (fold(of=3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def op5_wrapper_text(spark, sf_dir):
    return wrapper_text.main_text(table(spark, sf_dir, "pages"))


TOXIC = 0.3


def toxicity_model(spark, sf_dir):
    """Fitted to the labelled rows whose id does not fall into the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(fold(of=4) != 2)
    return gru_toxicity.train(gru_toxicity.sample(table(spark, sf_dir, "documents"), labels))


@query()
def op10_gru_toxicity(spark, sf_dir):
    out = gru_toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return out.select("doc_id", (fold(of=4) == 2).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


@query()
def op8_url_ngram_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


_RULES = ", ".join(f"('{rule}', '{verdict}')" for rule, verdict in url_filter.RULES)


@query(f"""WITH r AS (SELECT split_part(rule, '/', 1) AS dom, substr(rule, strpos(rule, '/')) AS below, rule, verdict FROM (VALUES {_RULES}) AS v(rule, verdict)),
u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS place FROM pages),
p AS (SELECT page_id, CASE WHEN place > 0 THEN regexp_extract(substr(url, place + 3), '^[^?#]*') ELSE '' END AS rest FROM u),
h AS (SELECT page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 substr(rest, length(split_part(rest, '/', 1)) + 1) AS path FROM p),
f AS (SELECT page_id, arg_max({{'rule': rule, 'verdict': verdict}}, length(rule)) AS best FROM h JOIN r ON (host = dom OR suffix(host, '.' || dom)) AND prefix(path, below) GROUP BY page_id)
SELECT h.page_id, host, path, best.rule AS rule, best.verdict AS verdict FROM h LEFT JOIN f USING (page_id)""")
def url_rules(spark, sf_dir):
    """The part of op8_url_ngram_filter that SQL can express."""
    return url_filter.ruled(table(spark, sf_dir, "pages"))


@query("""WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
 doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d""")
def op9_chunk_recipes(spark, sf_dir):
    return chunk_recipes.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


@query(f"""WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) AS nd, CAST(sum(len(w)) AS BIGINT) AS nl FROM d WHERE len(w) > 0),
b AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
q AS (SELECT DISTINCT t FROM b),
x AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) JOIN q USING (t) GROUP BY doc_id, t),
f AS (SELECT t, CAST(floor(1000 * ln((2 * (SELECT nd FROM s) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM x GROUP BY t),
m AS (SELECT doc_id, 50 + (50 * len(w) * (SELECT nd FROM s)) // greatest((SELECT nl FROM s), 1) AS m FROM d),
g AS (SELECT doc_id, t, f.w * ((1000000000 * tf) // (1000 * tf + 20 * m)) AS gain FROM x JOIN f USING (t) JOIN m USING (doc_id)),
r AS (SELECT item_id, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM b JOIN g USING (t) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50""")
def op11_aho_ranked(spark, sf_dir):
    return aho_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


PLANTED = "\\### Assistant: </turn> ok"
_ESCAPED = f"regexp_replace(text, '(\\\\*(?:{chat_format.CONTROL}))', '\\\\\\1', 'g')"
_ROLE = "replace(replace(replace(role, '\\', '\\\\'), '>', '\\>'), chr(10), '\\n')"


@query(f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(17 + length({_ROLE}) + length({_ESCAPED})) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id""")
def op12_typed_chat(spark, sf_dir):
    planted = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role").withColumn("text", F.lit(PLANTED))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat_format.digests(cut_lineage(chat_format.format_conversations(rows)))


@query()
def op13_text_alignment(spark, sf_dir):
    import public_tokenizers

    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return token_alignment.alignment(table(spark, sf_dir, "documents"), *paths)[0]


@query()
def pipeline(spark, sf_dir):
    """The stages of corpus_pipeline.py, one after another."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
