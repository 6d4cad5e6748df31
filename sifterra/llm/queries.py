"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_tree, fill_middle, jaccard_join, langid, line_rules, mixing, packing, periodic_runs, quality_fm, scaled_sketch, sharding, toxicity, vector_dedup
from .common import WORD_PATTERN, fold, held_out, next_row, small_table, table, word_count
from .kernels import MULTIPLIER, byte_values


def _trained_on(modulus: int, remainder: int):
    """Training rows: known ids outside the held-out fold."""
    return lambda doc_id: fold(doc_id, modulus) != remainder


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit_toxicity(docs, labels, _trained_on(3, 1))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs, langid.fit_languages(docs, _trained_on(4, 2)))
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "rejected")


def op3_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality_fm.fit_quality(docs, labels, _trained_on(5, 0))
    scored = quality_fm.score_quality(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), threshold=0.95)


OP4_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) >= 0.95::DOUBLE * a.norm * b.norm),
near AS (WITH RECURSIVE walk(a, b) AS (SELECT a, b FROM links UNION SELECT w.a, l.b FROM walk w JOIN links l ON w.b = l.a) SELECT a, min(b) AS m FROM walk GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN near ON near.a = vec_id LEFT JOIN degree ON degree.a = vec_id
"""


def public_tokenizer() -> dict[str, str]:
    """Places of the installed byte-level BPE files."""
    import public_tokenizers

    return {"tokenizer": str(public_tokenizers.path("byte_bpe_50k.json")), "ranks": str(public_tokenizers.path("byte_bpe_50k.tiktoken")), "pattern": public_tokenizers.PATTERN}


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), **public_tokenizer())


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.join_similar(docs, width=4, threshold=(85, 100))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs)
    return mixed.select("row.doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"), F.col("copies").cast("long").alias("copies"))


OP7_SQL = r"""
WITH sized AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, 1.0::DOUBLE + (row_number() OVER (ORDER BY source COLLATE C ASC NULLS LAST) - 1) % 3 AS weight, 3.0::DOUBLE * source_size AS cap FROM per),
levels AS (SELECT r.cap / r.weight AS at,
    (SELECT coalesce(sum(cap), 0) FROM ranked x WHERE x.cap / x.weight <= r.cap / r.weight) AS capped,
    (SELECT coalesce(sum(weight), 0) FROM ranked x WHERE x.cap / x.weight > r.cap / r.weight) AS free FROM ranked r
    UNION ALL SELECT 0, 0, (SELECT sum(weight) FROM ranked)),
level AS (SELECT coalesce(min(((SELECT sum(source_size) FROM per) - capped) / free), 1e300) AS level FROM levels l WHERE free > 0 AND
    ((SELECT sum(source_size) FROM per) - capped) / free >= l.at AND
    NOT EXISTS (SELECT 1 FROM ranked x WHERE x.cap / x.weight > l.at AND x.cap / x.weight <= ((SELECT sum(source_size) FROM per) - l.capped) / l.free)),
rates AS (SELECT source, source_size, least(cap, level * weight) AS target FROM ranked, level),
hashed AS (SELECT s.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 1 END AS rate,
    ('0x' || substr(md5('mix-1' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u
    FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 6) AS target,
    CAST(size * (floor(rate) + (u < rate - floor(rate))::INT) AS BIGINT) AS taken, CAST(floor(rate) + (u < rate - floor(rate))::INT AS BIGINT) AS copies FROM hashed
"""


def op9_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = small_table(spark, {"conv_id": pa.array([-7, -7]), "turn": pa.array([0, 1]), "role": pa.array(["user", "assistant"]), "text": pa.array([control] * 2)})
    files = public_tokenizer()
    segments, paths = chat_tree.build_tree(rows.unionByName(extra), **files)
    back = chat_tree.read_back(segments, paths, tokenizer=files["tokenizer"])
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    size = lambda c: F.length(c).cast("long")  # noqa: E731
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), chat_tree.digest(turns).alias("turns_sha256"), size("loss_text").alias("loss_chars"),
        chat_tree.digest(F.col("loss_text")).alias("loss_sha256"), size("formatted").alias("formatted_chars"),
    )  # fmt: skip


OP9_SQL = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
sized AS (SELECT *, length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\#<:]', '', 'g')) + 14 AS n FROM rows),
talks AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, CAST(sum(n) AS BIGINT) AS formatted_chars FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM talks
"""


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sharding.assign_shards(docs, 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_rules.apply_rules(docs).drop("source", "text_key", "text")


OP8_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
runs AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM words),
grams AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM runs),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE c > 1) GROUP BY r),
raw_lines AS (SELECT r, source, text, unnest(string_split(text, chr(10))) AS line FROM docs),
split_lines AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    md5(regexp_replace(translate(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g')) AS h
    FROM raw_lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM split_lines GROUP BY r),
lines AS (SELECT r, source, h, sum(n) AS n FROM split_lines GROUP BY r, source, h),
contents AS (SELECT r, md5(text) AS content FROM docs),
held AS (SELECT source, h, count(DISTINCT content) AS c FROM lines JOIN contents USING (r) GROUP BY source, h),
hosts AS (SELECT source, count(DISTINCT text) AS c FROM docs GROUP BY source),
frequent AS (SELECT held.source, h FROM held JOIN hosts ON held.source IS NOT DISTINCT FROM hosts.source WHERE held.c > 10 AND held.c > hosts.c * 0.10::DOUBLE),
gone AS (SELECT r, sum(n) AS n, count(*) AS c FROM lines JOIN frequent f ON lines.h = f.h AND lines.source IS NOT DISTINCT FROM f.source GROUP BY r),
figures AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.c, 0) AS BIGINT) AS n_lines_removed, CAST(len(w) - coalesce(gone.n, 0) AS BIGINT) AS n_words_left
    FROM docs JOIN words USING (r) LEFT JOIN dups USING (r) LEFT JOIN covered USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words_left >= n_words * 0.2::DOUBLE AS kept FROM figures
"""


OP10_SQL = """
WITH RECURSIVE bits(n, i, c) AS (SELECT n, 0, n FROM range(256) t(n) UNION ALL SELECT n, i + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE i < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE i = 8),
light AS (SELECT row_number() OVER () AS r, doc_id, text, md5(text) AS g, octet_length(encode(coalesce(text, ''))) + 8 AS size FROM documents),
sums AS (SELECT *, sum(size) OVER w - size AS before, row_number() OVER w AS place, sum(size) OVER () AS total FROM light WINDOW w AS (ORDER BY g NULLS FIRST, doc_id NULLS FIRST, r ROWS UNBOUNDED PRECEDING)),
grouped AS (SELECT *, min(before) OVER (PARTITION BY g) AS first, sum(size) OVER (PARTITION BY g) AS bytes FROM sums),
cut AS (SELECT *, least(23, CAST(floor((CASE WHEN bytes <= 0.02::DOUBLE * total / 24 THEN first ELSE before END) * 24.0::DOUBLE / total) AS INTEGER)) AS shard FROM grouped)
SELECT doc_id, CAST(size AS BIGINT) AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32,
    'bytes' AS law, shard, place - min(place) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM cut, crc
"""


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the documents, a tenth of which get a planted one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    sized = docs.withColumn("h", h).withColumn("n", F.when(F.col("h") % 10 == 0, word_count(F.col("text")).cast("int")))
    g = F.floor(F.col("h") / 10)
    drawn = sized.filter("n > 0").withColumn("a", F.pmod(g, F.col("n")).cast("int")).withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    planted = drawn.select("doc_id", periodic_runs.repeat_tail(F.col("text"), F.col("n"), F.col("a"), F.col("p"), WORD_PATTERN).alias("text"))
    rest = sized.filter("n IS NULL OR n = 0").select("doc_id", "text")
    found = periodic_runs.find_runs(rest.union(planted))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    best = F.col("best")
    return found.withColumn("best", periodic_runs.strongest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"), chat_tree.digest(lines).alias("runs_sha256"), chat_tree.digest(F.col("collapsed")).alias("collapsed_sha256"), "n_words",
    )  # fmt: skip


#: crc32 in SQL: ``crc`` has the table ``t``; the sum of the bytes of an expression follows.
CRC_SQL = """bits(n, i, c) AS (SELECT n, 0, n FROM range(256) t(n) UNION ALL SELECT n, i + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE i < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM bits WHERE i = 8)"""
OP11_SQL = rf"""
WITH RECURSIVE {CRC_SQL},
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
hashed AS (SELECT r, doc_id, w, len(w) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM docs, crc),
cuts AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM hashed),
planted AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END + 1]) END AS w FROM cuts),
words AS (SELECT r, n, unnest(range(n)) AS i, unnest(w) AS word FROM planted),
same AS (SELECT x.r, y.i - x.i AS p, x.i FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
islands AS (SELECT r, p, i, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS g FROM same),
stretches AS (SELECT r, p, min(i) AS s, max(i) + p + 1 AS e FROM islands GROUP BY r, p, g HAVING count(*) + p >= greatest(24, 3 * p)),
runs AS (SELECT r, s, e, min(p) AS q FROM stretches GROUP BY r, s, e),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY (e - s)::DOUBLE / q DESC, s, q) = 1),
listed AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY r),
dropped AS (SELECT DISTINCT r, unnest(range(s + q, e)) AS i FROM runs),
left_over AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, e - s AS length, q AS period, 1000 * (e - s) // q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256, n AS n_words
FROM planted LEFT JOIN best USING (r) LEFT JOIN listed USING (r) LEFT JOIN left_over USING (r)
"""


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fill_middle.restore(F.col("form"), F.col("output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", chat_tree.digest(F.col("output")).alias("output_sha256"), chat_tree.digest(back).alias("restored_sha256"))


OP12_SQL = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
draws AS (SELECT *, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM docs),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM draws),
parts AS (SELECT *, '<P>' || substring(text, 1, a) AS p, '<M>' || substring(text, a + 1, b - a) AS m, '<S>' || substring(text, b + 1) AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN s || p || m ELSE p || s || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM parts
"""


def op13_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = next_row(docs, "doc_id")
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - third), F.substr("next.text", F.lit(1), third))
    print_ = lambda c: scaled_sketch.fingerprint(F.col(c))  # noqa: E731
    both = pairs.select("doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"), F.col("next.text").alias("other"))
    both = both.select("*", print_("text").alias("fingerprint"), print_("edited").alias("edited_fingerprint"), print_("other").alias("following"))
    near = lambda other: scaled_sketch.likeness(F.col("fingerprint"), F.col(other))  # noqa: E731
    return both.select("doc_id", "n_chars", chat_tree.digest(F.col("edited")).alias("edited_sha256"), "fingerprint", "edited_fingerprint", near("edited_fingerprint").alias("near_edited"), near("following").alias("near_next"))



def _fold64(rows: str, value: str, salt: int, name: str) -> str:
    """SQL of the finalised 64-bit hash ``value`` of every row of ``rows``, as the column ``name``."""
    shift = lambda x: f"xor({x}, {x} >> 33)"  # noqa: E731
    times = lambda x, k: f"(({x}::UHUGEINT * {k}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"  # noqa: E731
    first = f"SELECT *, xor({value}, {salt * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF}::UBIGINT) AS x0 FROM {rows}"
    second = f"SELECT *, {times(shift('x0'), 0xFF51AFD7ED558CCD)} AS x1 FROM ({first})"
    third = f"SELECT *, {times(shift('x1'), 0xC4CEB9FE1A85EC53)} AS x2 FROM ({second})"
    return f"SELECT * EXCLUDE (x0, x1, x2), {shift('x2')} AS {name} FROM ({third})"


def _op13_sql() -> str:
    """The kernels' hashes said in SQL: bytes by table, words by polynomial, shingles by polynomial over words."""
    table = "([" + ", ".join(str(int(x)) for x in byte_values(True)) + "]::UBIGINT[])"
    m, size = int(MULTIPLIER), 18446744073709551616
    horner = lambda values: f"list_reduce(list_prepend(0::UHUGEINT, list_transform({values}, lambda x: x::UHUGEINT)), lambda a, x: (a * {m}::UHUGEINT % {size}::UHUGEINT + x) % {size}::UHUGEINT)::UBIGINT"  # noqa: E731
    width, lowest = scaled_sketch.WIDTH, ((1 << 64) - 1) // scaled_sketch.SCALE
    shingled = " UNION ALL ".join(
        f"({_fold64(f'(SELECT r, kind, {horner('w')} AS g FROM runs WHERE k = {k})', 'g', k, 'hash')})" for k in range(1, width + 1)
    )
    return rf"""
WITH docs AS (SELECT row_number() OVER (ORDER BY doc_id DESC) AS r, count(*) OVER () AS total, doc_id, coalesce(text, '') AS text FROM documents),
pairs AS (SELECT d.r, d.doc_id, d.text, substring(d.text, 1, length(d.text) - length(d.text) // 3) || substring(e.text, 1, length(d.text) // 3) AS edited FROM docs d JOIN docs e ON e.r = d.r % d.total + 1),
texts AS (SELECT r, 0 AS kind, text FROM pairs UNION ALL SELECT r, 1, edited FROM pairs),
words AS (SELECT r, kind, unnest(regexp_extract_all(text, '[^ 	-]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^ 	-]+'), 1) AS i FROM texts),
known AS (SELECT word, {horner(f"list_transform(list_reverse(regexp_extract_all(hex(encode(word)), '..')), lambda x: {table}[('0x' || x)::INTEGER + 1])")} AS p, octet_length(encode(word)) AS n FROM (SELECT DISTINCT word FROM words)),
hashed AS ({_fold64(f"(SELECT word, ((p::UHUGEINT + n::UHUGEINT) % {size}::UHUGEINT)::UBIGINT AS p FROM known)", "p", 1, "h")}),
lists AS (SELECT r, kind, list(h ORDER BY i) AS hs FROM words JOIN hashed USING (word) GROUP BY r, kind),
runs AS (SELECT r, kind, CASE WHEN len(hs) < {width} THEN len(hs) ELSE {width} END AS k, unnest(list_transform(range(1, greatest(len(hs) - {width}, 0) + 2), lambda i: hs[i : i + {width} - 1])) AS w FROM lists),
shingles AS (SELECT DISTINCT r, kind, hash FROM ({shingled})),
kept AS (SELECT r, kind, hash FROM (SELECT *, min(hash) OVER (PARTITION BY r, kind) AS least FROM shingles) WHERE hash < {lowest}::UBIGINT OR (hash = least AND least >= {lowest}::UBIGINT)),
prints AS (SELECT r, kind, list_sort(list_distinct(list(format('{{:010x}}', hash >> 24)))) AS p FROM kept GROUP BY r, kind),
both_prints AS (SELECT pairs.*, coalesce(a.p, []) AS own, coalesce(b.p, []) AS other FROM pairs LEFT JOIN prints a ON a.r = pairs.r AND a.kind = 0 LEFT JOIN prints b ON b.r = pairs.r AND b.kind = 1),
led AS (SELECT *, coalesce(lead(own) OVER (ORDER BY r), first_value(own) OVER (ORDER BY r)) AS following FROM both_prints)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(own, '') AS fingerprint, array_to_string(other, '') AS edited_fingerprint,
    CASE WHEN least(len(own), len(other)) > 0 THEN len(list_intersect(own, other)) / least(len(own), len(other)) WHEN len(own) = len(other) THEN 1.0::DOUBLE ELSE 0 END AS near_edited,
    CASE WHEN least(len(own), len(following)) > 0 THEN len(list_intersect(own, following)) / least(len(own), len(following)) WHEN len(own) = len(following) THEN 1.0::DOUBLE ELSE 0 END AS near_next FROM led
"""


OP13_SQL = _op13_sql()

QUERIES = {"op1_toxicity": op1_toxicity, "op2_langid": op2_langid, "op3_quality_fm": op3_quality_fm, "op4_vector_dedup": op4_vector_dedup, "op5_packing": op5_packing, "op6_jaccard_join": op6_jaccard_join, "op8_line_rules": op8_line_rules, "op7_mixing": op7_mixing, "op9_chat_tree": op9_chat_tree, "op10_sharding": op10_sharding, "op11_periodic_runs": op11_periodic_runs, "op12_fill_middle": op12_fill_middle, "op13_scaled_sketch": op13_scaled_sketch}
ORACLES = {"op11_periodic_runs": OP11_SQL, "op13_scaled_sketch": OP13_SQL, "op12_fill_middle": OP12_SQL, "op10_sharding": OP10_SQL, "op9_chat_tree": OP9_SQL, "op4_vector_dedup": OP4_SQL, "op8_line_rules": OP8_SQL, "op7_mixing": OP7_SQL}
