"""The registered queries of the engine over the given tables, and their DuckDB forms.

A document stands for an image: its whole text is read as bytes and box-averaged to a 32x32 grey sample.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred import schemas
from kindred.functions import hashing, phash, text
from kindred.operators import cache, groups, progress, simjoin
from kindred.operators.ordering import numbered
from kindred.shared import materialise, shared_dir
from kindred.sources import discovery, logs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(id_: str = "doc_id"):  # noqa: ANN202
    return F.concat(F.lit("doc-"), F.lpad(F.col(id_).cast("string"), 12, "0"))


def doc_records(spark: SparkSession, sf_dir: str, rotations: bool = True) -> DataFrame:
    """HASHED records of all documents."""
    hashed = phash.byte_hashes(_table(spark, sf_dir, "documents"), "doc_id", "text")
    path = _path()
    kept = F.col("hashes") if rotations else F.slice("hashes", 1, 1)
    return materialise(hashed.select(path.alias("path"), path.alias("basename"), F.col("doc_id").alias("ord"), kept.alias("hashes")), "records")


SAMPLES = r"""
    digits AS (SELECT doc_id, octet_length(encode(text)) AS n, string_split(rtrim(regexp_replace(hex(encode(text)), '(..)', '\1,', 'g'), ','), ',') AS list FROM documents WHERE text IS NOT NULL),
    pieces AS (SELECT doc_id, n, unnest(list) AS d, generate_subscripts(list, 1) - 1 AS i FROM digits WHERE n > 0),
    bytes AS (SELECT doc_id, n, i, (strpos('0123456789ABCDEF', d[1]) - 1) * 16 + strpos('0123456789ABCDEF', d[2]) - 1 AS v FROM pieces),
    places AS (SELECT range AS k FROM range(1024)),
    pixels AS (
        SELECT doc_id, ((i + 1) * 1024 - 1) // n AS k, sum(v)::BIGINT // count(*) AS p FROM bytes WHERE n >= 1024 GROUP BY ALL
        UNION ALL SELECT d.doc_id, k, v FROM (SELECT doc_id, n FROM digits WHERE n BETWEEN 1 AND 1023) d, places JOIN bytes b ON b.doc_id = d.doc_id AND b.i = k * d.n // 1024
        UNION ALL SELECT doc_id, k, 0 FROM digits, places WHERE n = 0
    ),
    turned AS (
        SELECT doc_id, 0 AS r, k // 32 AS x, k % 32 AS y, p FROM pixels
        UNION ALL SELECT doc_id, 1, k % 32, 31 - k // 32, p FROM pixels
        UNION ALL SELECT doc_id, 2, 31 - k // 32, 31 - k % 32, p FROM pixels
        UNION ALL SELECT doc_id, 3, 31 - k % 32, k // 32, p FROM pixels
    ),
    cosines AS (SELECT u.range AS u, x.range AS x, cos((2 * x.range + 1) * u.range * pi() / 64) AS c FROM range(8) u, range(32) x),
    rows_ AS (SELECT doc_id, r, t.x, c.u AS v, sum(p * c) AS s FROM turned t JOIN cosines c ON c.x = t.y GROUP BY ALL),
    low AS (
        SELECT doc_id, r, c.u * 8 + v AS i, (CASE WHEN c.u = 0 THEN 1 / sqrt(2) ELSE 1 END) * (CASE WHEN v = 0 THEN 1 / sqrt(2) ELSE 1 END) * sum(c * s) / 32 AS d
        FROM rows_ t JOIN cosines c ON c.x = t.x GROUP BY doc_id, r, c.u, v
    ),
    marks AS (SELECT doc_id, r, i, d >= sum(CASE WHEN i > 0 THEN d END) OVER (PARTITION BY doc_id, r) / 63 AS b FROM low),
    halves AS (SELECT doc_id, r, sum(CASE WHEN b AND i < 32 THEN 1::BIGINT << (31 - i) ELSE 0 END)::BIGINT AS hi, sum(CASE WHEN b AND i >= 32 THEN 1::BIGINT << (63 - i) ELSE 0 END)::BIGINT AS lo FROM marks GROUP BY doc_id, r),
    hashes AS (SELECT doc_id, r, printf('%08x', hi) || printf('%08x', lo) AS hash, hi, lo FROM halves)"""

#: Distinct hashes with their first document.
FIRSTS = "firsts AS (SELECT hash, any_value(hi) AS hi, any_value(lo) AS lo, min(doc_id) AS doc_id, count(DISTINCT doc_id) AS files FROM hashes {where} GROUP BY hash)"
DIST = "bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo))"
CHUNK = "least(bit_count(xor(a.hi >> 16, b.hi >> 16)), bit_count(xor(a.hi & 65535, b.hi & 65535)), bit_count(xor(a.lo >> 16, b.lo >> 16)), bit_count(xor(a.lo & 65535, b.lo & 65535)))"
PATH = "'doc-' || lpad({}::VARCHAR, 12, '0')"


def _pairs_sql(threshold: int, rotations: bool, mih: bool) -> str:
    lossy = f" AND {CHUNK} <= {min(threshold // 4, 2)}" if mih else ""
    return f"WITH {SAMPLES}, {FIRSTS.format(where='' if rotations else 'WHERE r = 0')} SELECT a.hash AS hash_a, b.hash AS hash_b, ({DIST})::INT AS dist FROM firsts a JOIN firsts b ON a.hash < b.hash WHERE {DIST} <= {threshold}{lossy}"


def _members_sql(threshold: int, more: str = "") -> str:
    """CTEs up to members(doc_id, path, id)."""
    return f"""WITH RECURSIVE {SAMPLES}, {FIRSTS.format(where="")},
    near AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM firsts a JOIN firsts b ON a.hash <> b.hash WHERE {DIST} <= {threshold}),
    shared AS (SELECT DISTINCT h.doc_id AS x, f.doc_id AS y FROM hashes h JOIN firsts f USING (hash)),
    edges AS (SELECT x, y FROM near UNION SELECT x, y FROM shared UNION SELECT y, x FROM shared),
    reach(doc_id, other) AS (SELECT DISTINCT doc_id, doc_id FROM hashes UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.other),
    members AS (SELECT doc_id, {PATH.format("doc_id")} AS path, {PATH.format("min(other)")} AS id FROM reach GROUP BY doc_id),
    sized AS (SELECT id, count(*) AS size, min(doc_id) AS first FROM members GROUP BY id HAVING count(*) > 1){more}"""


# fingerprints


@_query("phash_documents", f"WITH {SAMPLES} SELECT doc_id, hash FROM hashes WHERE r = 0")
def phash_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phash.byte_hashes(_table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.get("hashes", F.lit(0)).alias("hash"))


@_query("phash_rotations", f"WITH {SAMPLES} SELECT doc_id, string_agg(hash, ',' ORDER BY r) AS hashes FROM (SELECT doc_id, hash, min(r) AS r FROM hashes GROUP BY doc_id, hash) GROUP BY doc_id")
def phash_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phash.byte_hashes(_table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", F.array_join("hashes", ",").alias("hashes"))


BINARY = """
    vals AS (SELECT vec_id, unnest(embedding)::DOUBLE AS d, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
    marks AS (SELECT vec_id, i, d >= (sum(CASE WHEN i > 0 THEN d END ORDER BY i) OVER (PARTITION BY vec_id)) / 63 AS b FROM vals),
    halves AS (SELECT vec_id, sum(CASE WHEN b AND i < 32 THEN 1::BIGINT << (31 - i) ELSE 0 END)::BIGINT AS hi, sum(CASE WHEN b AND i >= 32 THEN 1::BIGINT << (63 - i) ELSE 0 END)::BIGINT AS lo FROM marks GROUP BY vec_id),
    vecs AS (SELECT vec_id, printf('%08x', hi) || printf('%08x', lo) AS hash, hi, lo FROM halves)""".replace("sum(CASE WHEN i > 0 THEN d END ORDER BY i) OVER", "sum(CASE WHEN i > 0 THEN d END) OVER")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", phash.binarised(F.col("embedding")).alias("hash"))


@_query("embedding_binarize", f"WITH {BINARY} SELECT vec_id, hash FROM vecs")
def embedding_binarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir)


@_query(
    "hamming_topk",
    f"""WITH {BINARY}, near AS (SELECT a.vec_id, b.vec_id AS neighbour, ({DIST})::INT AS dist FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
    SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbour)::INT AS rank, neighbour, dist FROM near QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbour) <= 5""",
)
def hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: rows whose id is divisible by 20, against all rows."""
    vectors = materialise(_vectors(spark, sf_dir), "vectors")
    return simjoin.nearest(vectors.filter("vec_id % 20 = 0"), vectors, 5, "vec_id", "vec_id")


@_query("range_search_t20", f"WITH {BINARY}, all_ AS (SELECT hash, any_value(hi) AS hi, any_value(lo) AS lo FROM vecs GROUP BY hash) SELECT a.hash, b.hash AS match, ({DIST})::INT AS dist FROM all_ a JOIN all_ b ON true WHERE a.hash IN (SELECT hash FROM vecs WHERE vec_id % 20 = 0) AND {DIST} <= 20")
def range_search_t20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: rows whose id is divisible by 20, against all rows."""
    vectors = materialise(_vectors(spark, sf_dir), "vectors")
    return simjoin.similarity_join(vectors.filter("vec_id % 20 = 0"), vectors, 20)


@_query("hash_chunks", f"WITH {BINARY} SELECT vec_id, (hi >> 16)::INT AS c0, (hi & 65535)::INT AS c1, (lo >> 16)::INT AS c2, (lo & 65535)::INT AS c3, hash ~ '^[0-9a-fA-F]{{16}}$' AS valid FROM vecs")
def hash_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = hashing.bits_of(F.col("hash"))
    return _vectors(spark, sf_dir).select("vec_id", *[hashing.chunk(bits, k).alias(f"c{k}") for k in range(3)], hashing.chunk_hex(F.col("hash"), 3).alias("c3"), hashing.is_valid_hash(F.col("hash")).alias("valid"))


# joins


def _self_join(threshold: int, rotations: bool, mode: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return simjoin.similarity_self_join(groups.exploded(doc_records(spark, sf_dir, rotations)), threshold, mode=mode)

    return run


for _name, _t, _rot, _mode in (
    ("simjoin_exact_t5", 5, False, "exact"), ("simjoin_exact_t10", 10, False, "exact"), ("simjoin_exact_t16", 16, False, "exact"), ("simjoin_mih_t10", 10, False, "mih"),
    ("simjoin_mih_t16", 16, False, "mih"), ("simjoin_rotations_t12", 12, True, "exact"), ("simjoin_rotations_mih_t16", 16, True, "mih"),
):
    _query(_name, _pairs_sql(_t, _rot, _mode == "mih"))(_self_join(_t, _rot, _mode))


@_query(
    "match_benchmark_t14",
    f"""WITH {SAMPLES}, {FIRSTS.format(where="WHERE r = 0")}, {SAMPLES.replace("FROM documents", "FROM (SELECT item_id AS doc_id, text FROM benchmark)").replace("digits", "digits2").replace("pieces", "pieces2").replace("bytes", "bytes2").replace("places", "places2").replace("pixels", "pixels2").replace("turned", "turned2").replace("cosines", "cosines2").replace("rows_", "rows2").replace("low ", "low2 ").replace("FROM low", "FROM low2").replace("low22", "low2").replace("marks", "marks2").replace("halves", "halves2").replace("hashes", "hashes2")}
    SELECT {PATH.format("a.doc_id")} AS path, a.hash, b.hash AS match, {PATH.format("b.doc_id")} AS file_path, ({DIST})::INT AS dist FROM (SELECT * FROM hashes2 WHERE r = 0) a JOIN firsts b ON {DIST} <= 14""",
)
def match_benchmark_t14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items as probes against the index of documents, rotation 0."""
    items = phash.byte_hashes(_table(spark, sf_dir, "benchmark"), "item_id", "text")
    probe = items.select(_path("item_id").alias("path"), F.col("item_id").alias("ord"), F.slice("hashes", 1, 1).alias("hashes"))
    return groups.matches(probe, doc_records(spark, sf_dir, False), 14)


@_query("first_file_per_hash", f"WITH {SAMPLES}, {FIRSTS.format(where='')} SELECT hash, {PATH.format('doc_id')} AS path, files FROM firsts")
def first_file_per_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.first_per_hash(doc_records(spark, sf_dir))


@_query("index_size", f"WITH {SAMPLES} SELECT count(DISTINCT hash) AS hashes FROM hashes")
def index_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.index_size(doc_records(spark, sf_dir))


# groups


def _with_members(threshold: int, then: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        records = doc_records(spark, sf_dir)
        return then(records, materialise(groups.components(records, threshold), "members"))

    return run


def _groups_flat(records: DataFrame, members: DataFrame) -> DataFrame:
    found = groups.build_groups(records, members)
    return found.select("id", "kind", "representative", F.array_join("files", ",").alias("files"), "evidence", "size", "min_ord")


_GROUPS_SQL = f"""{{}} SELECT m.id, 'fast' AS kind, {PATH.format("first")} AS representative, string_agg(path, ',' ORDER BY m.doc_id) AS files,
    'Perceptual hash · ' || (SELECT hash FROM hashes h WHERE h.doc_id = first AND r = 0) AS evidence, size, first AS min_ord
    FROM members m JOIN sized USING (id) GROUP BY m.id, first, size"""
_SUMMARY_SQL = """{} SELECT count(*) AS groups, coalesce(sum(size), 0)::BIGINT AS grouped, coalesce(sum(size - 1), 0)::BIGINT AS removable, coalesce(max(size), 0)::BIGINT AS largest,
    (SELECT count(*) FROM members) AS scanned, (SELECT count(*) FROM members) - coalesce(sum(size), 0)::BIGINT AS unique_images,
    round(coalesce(sum(size), 0) * 100.0::DOUBLE / nullif((SELECT count(*) FROM members), 0), 6) AS duplicate_rate FROM sized"""

for _t in (5, 12, 16):
    _query(f"components_t{_t}", f"{_members_sql(_t)} SELECT path, id FROM members")(_with_members(_t, lambda records, members: members))
for _t in (5, 12):
    _query(f"duplicate_groups_t{_t}", _GROUPS_SQL.format(_members_sql(_t)))(_with_members(_t, _groups_flat))
for _t in (0, 5, 16):
    _query(f"group_summary_t{_t}", _SUMMARY_SQL.format(_members_sql(_t)))(
        _with_members(_t, lambda records, members: groups.summary(groups.group_sizes(members), members).drop("per_second").withColumn("duplicate_rate", F.round("duplicate_rate", 6)))
    )
_query("removal_candidates_t10", f"{_members_sql(10)} SELECT m.id, {PATH.format('first')} AS representative, path FROM members m JOIN sized USING (id) WHERE m.doc_id <> first")(_with_members(10, groups.removal_candidates))


@_query(
    "rematch_thresholds",
    f"""WITH RECURSIVE {SAMPLES}, {FIRSTS.format(where="")}, ts AS (SELECT unnest([4, 5, 10, 12]) AS t),
    pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, min({DIST}) AS dist FROM firsts a JOIN firsts b ON a.hash <> b.hash WHERE {DIST} <= 12 GROUP BY a.doc_id, b.doc_id),
    shared AS (SELECT DISTINCT h.doc_id AS x, f.doc_id AS y FROM hashes h JOIN firsts f USING (hash)),
    edges AS (SELECT t, x, y FROM ts JOIN pairs ON dist <= t UNION SELECT t, x, y FROM ts, shared UNION SELECT t, y, x FROM ts, shared),
    reach(t, doc_id, other) AS (SELECT DISTINCT t, doc_id, doc_id FROM ts, hashes UNION SELECT r.t, r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.other AND e.t = r.t),
    members AS (SELECT t, doc_id, min(other) AS id FROM reach GROUP BY ALL),
    sized AS (SELECT t, id, count(*) AS size FROM members GROUP BY ALL HAVING count(*) > 1)
    SELECT t AS threshold, count(size) AS groups, coalesce(sum(size), 0)::BIGINT AS grouped FROM ts LEFT JOIN sized USING (t) GROUP BY t""",
)
def rematch_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One set of hashes, matched at several thresholds."""
    records, out = doc_records(spark, sf_dir), None
    for t, sizes in groups.sizes_at(records, (4, 5, 10, 12)).items():
        row = sizes.agg(F.count("*").alias("groups"), F.coalesce(F.sum("size"), F.lit(0)).alias("grouped")).select(F.lit(t).alias("threshold"), "groups", "grouped")
        out = row if out is None else out.unionByName(row)
    return out


@_query("stream_groups_t12", _GROUPS_SQL.format(_members_sql(12)))
def stream_groups_t12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same groups from a file stream in micro-batches."""
    import uuid

    from kindred.streaming.incremental import IncrementalGroups

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    doc_records(spark, sf_dir).repartition(4).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(schemas.HASHED).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    engine = IncrementalGroups(spark, f"{base}/state", threshold=12)
    engine.start(stream, f"{base}/checkpoint", available_now=True).awaitTermination()
    found = engine.groups()
    return found.select("id", "kind", "representative", F.array_join("files", ",").alias("files"), "evidence", "size", "min_ord")


# sources and cache

_EXT = ("png", "JPG", "jpeg", "bmp", "GIF", "webp", "tiff", "tif", "txt")
_EXT_SQL = "list_extract(['" + "','".join(_EXT) + "'], (doc_id % 9)::INT + 1)"
_FILE_SQL = f"'/corpus/' || coalesce(source, 'none') || '/' || lpad(doc_id::VARCHAR, 12, '0') || '.' || {_EXT_SQL}"


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file name for every document, its extension by the id; size and time from its fields."""
    extension = F.element_at(F.array(*map(F.lit, _EXT)), (F.pmod("doc_id", F.lit(9)) + 1).cast("int"))
    path = F.concat(F.lit("/corpus/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit("."), extension)
    return _table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") * 1000.0).alias("mtime_ms"))


_IMAGES = f"files AS (SELECT doc_id, {_FILE_SQL} AS path, n_chars AS size, doc_id * 1000.0::DOUBLE AS mtime_ms FROM documents), images AS (SELECT *, string_split(path, '/')[-1] AS basename, row_number() OVER (ORDER BY path) - 1 AS ord FROM files WHERE doc_id % 9 < 7)"


@_query("discover_images", f"WITH {_IMAGES} SELECT path, basename, ord FROM images")
def discover_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discovery.from_paths(doc_files(spark, sf_dir)).select("path", "basename", "ord")


@_query("folder_preview", f"WITH {_IMAGES} SELECT count(*) AS image_count, (SELECT string_agg(path, ',' ORDER BY ord) FROM images WHERE ord < 6) AS samples, (count(*) - least(count(*), 6))::BIGINT AS overflow FROM images")
def folder_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = discovery.preview(discovery.from_paths(doc_files(spark, sf_dir)))
    return found.select("image_count", F.array_join("samples", ",").alias("samples"), F.col("overflow").cast("long").alias("overflow"))


def doc_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache row for every labelled document: of a wrong size where its quality is 0, malformed where it is toxic."""
    rows = _table(spark, sf_dir, "labels").join(doc_files(spark, sf_dir), "doc_id")
    size = F.when(F.col("quality") == 0, F.col("size") + 1).otherwise(F.col("size"))
    good = F.concat(F.lit("0000"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    return rows.select(
        F.lit(schemas.SCHEMA_VERSION).alias("schema_version"), F.lit(schemas.ALGORITHM_VERSION).alias("algorithm_version"), F.col("path").alias("file_path"), text.basename(F.col("path")).alias("basename"),
        F.when(F.col("toxic") == 1, F.array(F.lit("hash-0"))).otherwise(F.array(good)).alias("hashes"), size.alias("size"), (F.col("mtime_ms") + 0.5).alias("mtime_ms"), F.timestamp_seconds(F.col("doc_id") + 1_700_000_000).alias("cached_at"),
    )


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_files(spark, sf_dir).filter(discovery.is_image(F.col("path"))).withColumn("basename", text.basename(F.col("path")))


_CACHE = f"{_IMAGES}, cache AS (SELECT l.*, f.path AS file_path FROM labels l JOIN files f USING (doc_id)), known AS (SELECT i.*, CASE WHEN c.doc_id IS NULL THEN 'missing' WHEN c.quality = 0 OR c.toxic = 1 THEN 'stale' ELSE 'valid' END AS status FROM images i LEFT JOIN cache c ON c.file_path = i.path)"


@_query("cache_classify", f"WITH {_CACHE} SELECT path, status, CASE WHEN status = 'valid' THEN '0000' || lpad(doc_id::VARCHAR, 12, '0') END AS hashes FROM known")
def cache_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cache.classify(image_files(spark, sf_dir), doc_cache(spark, sf_dir))
    return found.select("path", "status", F.array_join("hashes", ",").alias("hashes"))


@_query("cache_info", f"WITH {_CACHE} SELECT count(*) AS current_image_count, count(*) FILTER (status = 'valid') AS valid_entry_count, count(*) FILTER (status = 'stale') AS stale_entry_count, count(*) FILTER (status = 'missing') AS missing_entry_count, (SELECT count(*) FROM cache) AS total_entries, 365 AS ttl_days FROM known")
def cache_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.info(image_files(spark, sf_dir), doc_cache(spark, sf_dir)).drop("folder", "cache_path", "size_bytes", "updated_at")


@_query("cache_stats", f"WITH {_CACHE} SELECT count(*) FILTER (status = 'valid') AS hits, count(*) FILTER (status = 'missing') AS misses, count(*) FILTER (status = 'stale') AS stale, count(*) FILTER (status <> 'valid') AS writes, 0::BIGINT AS errors FROM known")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.stats(cache.classify(image_files(spark, sf_dir), doc_cache(spark, sf_dir)))


@_query("cache_prune", f"WITH {_CACHE} SELECT file_path FROM cache WHERE file_path IN (SELECT path FROM images)")
def cache_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.prune(doc_cache(spark, sf_dir), image_files(spark, sf_dir)).select("file_path")


@_query(
    "cache_upsert",
    f"WITH {_CACHE} SELECT path AS file_path, size, 'fresh' AS hashes FROM known WHERE status <> 'valid' UNION ALL SELECT file_path, f.size + CASE WHEN quality = 0 THEN 1 ELSE 0 END, CASE WHEN toxic = 1 THEN 'hash-0' ELSE '0000' || lpad(f.doc_id::VARCHAR, 12, '0') END FROM cache c JOIN files f USING (doc_id) WHERE file_path NOT IN (SELECT path FROM known WHERE status <> 'valid')",
)
def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = doc_cache(spark, sf_dir)
    todo = cache.classify(image_files(spark, sf_dir), held).filter("status <> 'valid'")
    fresh = cache.cache_rows(todo.withColumn("hashes", F.array(F.lit("fresh"))))
    return cache.upsert(held, fresh).select("file_path", "size", F.array_join("hashes", ",").alias("hashes"))


@_query("cache_newest", f"WITH {_CACHE} SELECT file_path FROM cache ORDER BY doc_id DESC, file_path LIMIT 250000")
def cache_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.newest(doc_cache(spark, sf_dir)).select("file_path")


@_query("cache_folder_id", "SELECT page_id, 'folder-' || left(sha256(lower(url)), 32) AS cache_id FROM pages")
def cache_folder_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", text.folder_cache_id(F.col("url")).alias("cache_id"))


# progress and logs

_RUN = "placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS cur, count(*) OVER (PARTITION BY user_id) AS total, (epoch_us(ts) // 1000) - min((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id) AS elapsed FROM events)"


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    start = events.groupBy("user_id").agg(F.min(progress.millis("ts")).alias("start"))
    counted = progress.running_count(events.select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", seconds=86_400)
    return counted.join(start, "user_id").withColumn("elapsed", progress.millis("ts") - F.col("start"))


@_query("progress_eta", f"WITH {_RUN} SELECT event_id, cur AS current, total, floor(cur * 100.0 / total + 0.5)::BIGINT AS percent, CASE WHEN cur < total THEN floor(elapsed::DOUBLE / cur * (total - cur) + 0.5)::BIGINT END AS eta_ms FROM placed")
def progress_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _progress(spark, sf_dir)
    current, total = F.col("current"), F.col("total")
    return rows.select("event_id", current.cast("long").alias("current"), "total", progress.percent_complete(current, total).alias("percent"), progress.time_left(F.col("elapsed"), current, total).alias("eta_ms"))


@_query(
    "progress_text",
    f"""WITH {_RUN}, t AS (SELECT *, CASE WHEN cur < total THEN floor(elapsed::DOUBLE / cur * (total - cur) + 0.5)::BIGINT END AS eta, CASE WHEN event_type = 'view' THEN 'comparing' ELSE 'discovering' END AS phase FROM placed)
    SELECT event_id, concat_ws(' • ', cur || '/' || total || CASE WHEN phase = 'comparing' THEN ' comparisons' ELSE ' images' END,
        CASE WHEN eta > 0 THEN CASE WHEN ceil(eta / 1000.0) < 60 THEN '~' || ceil(eta / 1000.0)::BIGINT || 's remaining' ELSE '~' || ceil(ceil(eta / 1000.0) / 60.0)::BIGINT || 'm remaining' END END) AS line,
        CASE phase WHEN 'comparing' THEN 'comparing matches' ELSE 'discovering files' END AS label, CASE phase WHEN 'comparing' THEN 'completed' ELSE 'pending' END AS hash_step FROM t""",
)
def progress_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _progress(spark, sf_dir).join(_table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")
    phase = F.when(F.col("event_type") == "view", F.lit("comparing")).otherwise(F.lit("discovering"))
    left = progress.time_left(F.col("elapsed"), F.col("current"), F.col("total"))
    line = text.progress_text(F.col("current"), F.col("total"), phase, F.col("elapsed"), left)
    return rows.select("event_id", line.alias("line"), text.phase_label(phase).alias("label"), text.phase_state(phase, "hashing").alias("hash_step"))


@_query(
    "throttle_1day",
    """WITH RECURSIVE ev AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    walk AS (SELECT event_id, user_id, us, n, us AS last, true AS kept FROM ev WHERE n = 1
        UNION ALL SELECT e.event_id, e.user_id, e.us, e.n, CASE WHEN e.us - w.last >= 86400000000 THEN e.us ELSE w.last END, e.us - w.last >= 86400000000 FROM walk w JOIN ev e ON e.user_id = w.user_id AND e.n = w.n + 1)
    SELECT event_id FROM walk WHERE kept""",
)
def throttle_1day(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return progress.throttled(events, "user_id", "ts", "event_id", gap_ms=86_400_000, seconds=864_000).select("event_id")


@_query("first_times", "SELECT user_id, min((epoch_us(ts) // 1000)) FILTER (event_type = 'view') - min((epoch_us(ts) // 1000)) AS time_to_first_file_ms, min((epoch_us(ts) // 1000)) FILTER (event_type = 'click') - min((epoch_us(ts) // 1000)) AS time_to_first_hash_ms FROM events GROUP BY user_id")
def first_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.first_times(_table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "view", "click")


@_query("recent_activity", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 24")
def recent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.recent(_table(spark, sf_dir, "events"), "ts", "event_id").select("event_id", "event_type")


@_query("log_entries", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(((epoch_us(ts) // 1000) % 1000)::VARCHAR, 3, '0') || 'Z' AS timestamp, CASE WHEN value < 0 THEN 'warn' ELSE 'info' END AS level, 'scan' AS scope, event_type AS event, user_id::VARCHAR AS user_id FROM events")
def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("value") < 0, F.lit("warn")).otherwise(F.lit("info"))
    entry = logs.entry_column(F.col("ts").cast("timestamp"), level, F.lit("scan"), F.col("event_type"), F.struct("user_id"))
    made = _table(spark, sf_dir, "events").select("event_id", entry.alias("entry"))
    parts = [F.get_json_object("entry", f"$.{k}").alias(k) for k in ("timestamp", "level", "scope", "event")]
    return made.select("event_id", *parts, F.get_json_object("entry", "$.details.user_id").alias("user_id"))


# strings


@_query(
    "path_functions",
    r"""WITH t AS (SELECT page_id, url, replace(url, '/', '\') AS flat FROM pages)
    SELECT page_id, string_split(url, '/')[-1] AS basename, coalesce(list_filter(string_split(flat, '\'), lambda p: p <> '')[-1], url) AS file_name, left(flat, len(flat) - strpos(reverse(flat), '\')) AS directory,
        CASE WHEN len(url) <= 24 THEN url ELSE left(url, 14) || '…' || right(url, 9) END AS short,
        replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM t""",
)
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    columns = {"basename": text.basename(url), "file_name": text.file_name(url), "directory": text.directory(url), "short": text.shorten_middle(url, 24), "escaped": text.escape_html(url)}
    return _table(spark, sf_dir, "pages").select("page_id", *[c.alias(n) for n, c in columns.items()])


@_query(
    "escape_pages",
    """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped FROM pages""",
)
def escape_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", F.md5(text.escape_html(F.col("html"))).alias("escaped"))


_MS = "SELECT event_id, (event_id * 37 % 400000)::BIGINT AS ms FROM events"


@_query(
    "format_duration",
    f"""WITH t AS ({_MS}) SELECT event_id, CASE WHEN ms < 1000 THEN ms || ' ms' WHEN ms < 60000 THEN printf('%d.%d s', ((ms + 50) // 100) // 10, ((ms + 50) // 100) % 10)
        ELSE (ms // 60000) || 'm ' || floor((ms % 60000) / 1000.0 + 0.5)::BIGINT || 's' END AS shown FROM t""",
)
def format_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = (F.col("event_id") * 37 % 400_000).cast("long")
    return _table(spark, sf_dir, "events").select("event_id", text.format_duration(ms).alias("shown"))


@_query("number_grouping", "SELECT event_id, CASE WHEN n >= 1000000 THEN (n // 1000000) || ',' || lpad((n // 1000 % 1000)::VARCHAR, 3, '0') || ',' || lpad((n % 1000)::VARCHAR, 3, '0') WHEN n >= 1000 THEN (n // 1000) || ',' || lpad((n % 1000)::VARCHAR, 3, '0') ELSE n::VARCHAR END AS shown FROM (SELECT event_id, event_id * 137 AS n FROM events)")
def number_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", text.grouped_number(F.col("event_id") * 137).alias("shown"))


@_query("cache_text", f"WITH {_CACHE}, c AS (SELECT count(*) AS n, count(*) FILTER (status = 'valid') AS v, count(*) FILTER (status = 'stale') AS s, count(*) FILTER (status = 'missing') AS m FROM known) SELECT 'Cache: ' || v || '/' || n || ' image hashes ready' || CASE WHEN m > 0 THEN ', ' || m || ' missing' ELSE '' END || CASE WHEN s > 0 THEN ', ' || s || ' stale' ELSE '' END || '. TTL 365 days.' AS line FROM c")
def cache_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = cache.info(image_files(spark, sf_dir), doc_cache(spark, sf_dir))
    return i.select(text.cache_text(F.col("current_image_count"), F.col("valid_entry_count"), F.col("missing_entry_count"), F.col("stale_entry_count"), F.col("ttl_days")).alias("line"))


@_query("event_order", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS ord FROM events")
def event_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(_table(spark, sf_dir, "events").select("event_id", "ts"), F.col("ts"), F.col("event_id")).select("event_id", "ord")
