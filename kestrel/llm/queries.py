"""The training-data queries that the driver registers, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import chat, decontaminate, embedding_dedup, html_extract, licences, manifest, ngram_join, packing, sentence_pieces, sharding, spelling, toxicity, url_filter
from kestrel.llm.common import table

URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "text", "n_chars")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


def vocabulary() -> str:
    """Where the public vocabulary file is."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), vocabulary())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    own = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(own).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    logged = rows.unionByName(extra).repartition("conv_id")
    # Rows that share a turn number stay turns of their own.
    part = F.row_number().over(W.partitionBy("conv_id", "turn").orderBy("role", "text"))
    events = logged.select("*", part.alias("part"), F.lit(0).alias("seq"), F.lit("message").alias("event"))
    done = chat.render(chat.reconstruct(events)).select(
        "conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"),
        chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge_urls(pages, url_filter.rules_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = sentence_pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    both = sentence_pieces.decode(coded.select("doc_id", "ids"), model)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = [F.col("n_chars") + 1 if i == 3 else f for i, f in enumerate(fields)]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = docs.select("doc_id", "lang", manifest.digest(fields).alias("leaf"), F.when(tampered, manifest.digest(more)).alias("changed"))
    return manifest.manifest(leaves).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Runs of under seven letters give no word of seven, so they are not even cut out.
    runs = table(spark, sf_dir, "documents").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z\u00C0-\u00FF]{7,}"), 0)).alias("run")
    )
    lower = runs.select("id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    hashed = lower.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= 7)
    return spelling.variants(words.groupBy("word").agg(F.count("*").alias("n")).where("n >= 2"))


WORDS_SQL = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {WORDS_SQL} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(w)) AS n,
               array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS p
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
occ AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS p
        FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, occ.n, item_id FROM occ JOIN win USING (n, p)),
pos AS (SELECT doc_id, count(DISTINCT k) AS n_hit
        FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
          FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ESC_SQL = (
    "replace(replace(replace(replace(replace({0}, '\\', '\\\\'), '<s>', '<\\s>'), '</s>', '<\\/s>'), "
    "'[INST]', '[\\INST]'), '[/INST]', '[\\/INST]')"
)
OP5_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(i))
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(21 + length({ESC_SQL.format('role')}) + length({ESC_SQL.format('text')})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

OP8_SQL = """
WITH u AS (SELECT page_id,
  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                            ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best AS (SELECT page_id, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS verdict
         FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN best USING (page_id)
"""



def _canonical_sql(column: str) -> str:
    quoted = lambda x: x.replace("'", "''")
    out = f"lower(coalesce({column}, ''))"
    for _, pattern, to in [("", licences.COPYRIGHT_LINE, " "), *licences.SPELLINGS, ("", "[^a-z0-9]+", " ")]:
        out = f"regexp_replace({out}, '{quoted(pattern)}', '{to}', 'g')"
    return f"trim({out}, ' ')"


_KNOWN_SQL = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in [*licences.TEXTS, *licences.NOTICES])
OP9_SQL = f"""
WITH k(licence, body) AS (VALUES {_KNOWN_SQL}),
known AS (SELECT {_canonical_sql('body')} AS c, min(licence) AS licence FROM k GROUP BY 1),
d AS (SELECT doc_id, text, {_canonical_sql('text')} AS c FROM documents),
lines AS (SELECT doc_id, {_canonical_sql('line')} AS c FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
stated AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices FROM lines JOIN known USING (c) WHERE c <> '' GROUP BY doc_id)
SELECT doc_id, CASE WHEN c <> '' THEN sha256(c) END AS canonical_sha256, known.licence AS licence, coalesce(notices, '') AS notices
FROM d LEFT JOIN known USING (c) LEFT JOIN stated USING (doc_id)
"""

#: CRC-32 byte by byte: ``crc`` over the list of a text's UTF-8 bytes, with the table ``t`` beside it.
CRC_SQL = """crc_t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def _crc_sql(text: str) -> str:
    byte = f"list_transform(range(strlen({text})), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {byte}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


_PART_SQL = "coalesce(strlen({0}) || ':' || {0}, '-')"


def _leaf_sql(more: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST(n_chars + {more} AS VARCHAR)", "text"]
    return "sha256(" + " || ".join(_PART_SQL.format(f) for f in fields) + ")"


OP12_SQL = f"""
WITH RECURSIVE {CRC_SQL},
d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf_sql('0')} AS leaf, CASE WHEN {_crc_sql('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_leaf_sql('1')} END AS changed FROM documents, crc_t),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
lv(tree, level, pos, h, n) AS (SELECT tree, 0, pos, leaf, n FROM p
  UNION ALL SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM lv WHERE n > 1 GROUP BY tree, level, pos // 2),
sub AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM lv WHERE n = 1),
tp(level, pos, h, n) AS (SELECT 0, pos, subroot, n FROM sub
  UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2) FROM tp WHERE n > 1 GROUP BY level, pos // 2),
-- The trees of the groups, and the one above them as tree 'top'.
nd AS (SELECT * FROM lv UNION ALL SELECT 'top', * FROM tp),
up(tree, own, level, pos, proof, f) AS (SELECT tree, pos, 0, pos, '', coalesce(changed, leaf) FROM p
  UNION ALL SELECT up.tree, own, up.level + 1, up.pos // 2, proof || coalesce(b.h, ''), sha256(CASE WHEN up.pos % 2 = 0 THEN f || coalesce(b.h, '') ELSE b.h || f END)
  FROM up JOIN nd a ON a.tree = up.tree AND a.level = up.level AND a.pos = up.pos AND a.n > 1 LEFT JOIN nd b ON b.tree = up.tree AND b.level = up.level AND b.pos = xor(up.pos, 1)),
mid AS (SELECT up.* FROM up JOIN nd a ON a.tree = up.tree AND a.level = up.level AND a.pos = up.pos AND a.n = 1),
ov(tree, own, level, pos, proof, f) AS (SELECT mid.tree, own, 0, sub.pos, proof, f FROM mid JOIN sub USING (tree)
  UNION ALL SELECT ov.tree, own, ov.level + 1, ov.pos // 2, proof || coalesce(b.h, ''), sha256(CASE WHEN ov.pos % 2 = 0 THEN f || coalesce(b.h, '') ELSE b.h || f END)
  FROM ov JOIN nd a ON a.tree = 'top' AND a.level = ov.level AND a.pos = ov.pos AND a.n > 1 LEFT JOIN nd b ON b.tree = 'top' AND b.level = ov.level AND b.pos = xor(ov.pos, 1)),
rt AS (SELECT h AS root, level AS depth FROM tp WHERE n = 1)
SELECT p.doc_id, p.leaf, sub.subroot, root, sha256(ov.proof) AS proof_sha256, ov.f AS folded_root, ov.f = root AS verified
FROM p JOIN sub USING (tree) JOIN ov ON ov.tree = p.tree AND ov.own = p.pos JOIN rt ON ov.level = depth
"""

OP13_SQL = f"""
WITH RECURSIVE {CRC_SQL},
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
u AS (SELECT id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY 1, 2),
h AS (SELECT run, n, {_crc_sql("(id || ':' || run)")} AS h FROM u, crc_t),
c AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM c WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
-- Near words share a text with a letter left out at the same place, or one is the other with a letter left out.
k AS (SELECT word, n, length(word) AS l, i, left(word, i) || '*' || substr(word, i + 2) AS k, left(word, i) || substr(word, i + 2) AS o FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
e AS (SELECT a.word, b.word AS other, b.n AS n_other FROM k a JOIN k b ON a.k = b.k AND a.word <> b.word
  UNION SELECT k.word, w.word, w.n FROM k JOIN w ON w.word = k.o UNION SELECT w.word, k.word, k.n FROM k JOIN w ON w.word = k.o),
m AS (SELECT word, count(*) AS n_near, min(struct_pack(a := -n_other, b := other)) AS b FROM e GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.a >= 10 * w.n THEN b.b END AS form, CASE WHEN -b.a >= 10 * w.n THEN -b.a END AS form_n FROM w LEFT JOIN m USING (word)),
g(word, at_) AS (SELECT word, word FROM f UNION ALL SELECT g.word, f.form FROM g JOIN f ON f.word = g.at_ WHERE f.form IS NOT NULL)
SELECT f.word, f.form, g.at_ AS root, f.n, f.n_near, f.form_n FROM f JOIN g USING (word) JOIN f z ON z.word = g.at_ WHERE z.form IS NULL
"""

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_html_extract": op2_html_extract,
    "op3_toxicity": op3_toxicity,
    "op4_pattern_packing": op4_pattern_packing,
    "op5_chat_format": op5_chat_format,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_ngram_join": op7_ngram_join,
    "op8_url_filter": op8_url_filter,
    "op9_licence_scan": op9_licence_scan,
    "op10_sharding": op10_sharding,
    "op11_sentence_pieces": op11_sentence_pieces,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLES = {"op1_decontaminate": OP1_SQL, "op5_chat_format": OP5_SQL, "op8_url_filter": OP8_SQL, "op9_licence_scan": OP9_SQL, "op12_merkle_manifest": OP12_SQL, "op13_spelling_variants": OP13_SQL}
