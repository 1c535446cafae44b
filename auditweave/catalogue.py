"""Named queries over the test tables, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model as M
from .functions import hashing, paths
from .operators import candidates as C
from .operators import components as G
from .operators import evaluation as E
from .operators import findings as FD
from .operators import inventory as I
from .operators import jobs as J
from .operators import repair as R
from .operators import reviews as RV
from .operators import score as S
from .operators.classes import Classes
from .plans.audit import Audit
from .plans import report as RP
from .plans.findings_query import FindingsQuery
from .sources import archives as A
from .sources import tables as T
from .storage import fresh_path

NEAR, STRONG, TOP_K, COSINE, WIDE = 8, 4, 10, 0.35, 16
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# ---- SQL that oracles share ----

SAMPLES = """
samples AS (SELECT doc_id AS idx, 's' || lpad(CAST(doc_id AS VARCHAR), 7, '0') AS sample_id,
  CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 = 7 THEN 'val' ELSE 'test' END AS split, source AS label,
  sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS bytes, CAST(length(text) AS BIGINT) AS width,
  CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS height, lang AS img_format, n_chars < 20 AS corrupt FROM documents)"""
PRINTS = """
tokens AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents),
bits AS (SELECT doc_id, i, sum(CASE WHEN ((('0x' || substr(md5(w), 1, 16))::UBIGINT >> i) & 1) = 1 THEN 1 ELSE -1 END) AS s FROM tokens, range(64) r(i) GROUP BY ALL),
prints AS (SELECT doc_id AS idx, CAST(sum(CASE WHEN s > 0 THEN CAST(1 AS HUGEINT) << CAST(i AS INT) ELSE 0 END) AS UBIGINT) AS h FROM bits GROUP BY ALL)"""
EXACT = """
exact AS (SELECT a.idx AS a, b.idx AS b, 'sha256' AS method, 0.0::DOUBLE AS distance, 1.0::DOUBLE AS similarity
  FROM samples a JOIN samples b ON a.sha256 = b.sha256 AND a.idx < b.idx WHERE NOT a.corrupt AND NOT b.corrupt)"""
NEARS = f"""
valid_prints AS (SELECT p.* FROM prints p JOIN samples s USING (idx) WHERE NOT s.corrupt),
near AS (SELECT a.idx AS a, b.idx AS b, 'phash' AS method, CAST(bit_count(xor(a.h, b.h)) AS DOUBLE) AS distance, round(1 - bit_count(xor(a.h, b.h)) / 64.0::DOUBLE, 6) AS similarity
  FROM valid_prints a JOIN valid_prints b ON a.idx < b.idx AND bit_count(xor(a.h, b.h)) <= {NEAR})"""


def similar_sql(source: str) -> str:
    return f"""
vectors AS ({source}),
ranked AS (SELECT a.idx AS a, b.idx AS b, round(list_dot_product(a.v, b.v), 12) AS s, row_number() OVER (PARTITION BY a.idx ORDER BY round(list_dot_product(a.v, b.v), 12) DESC, b.idx) AS r FROM vectors a, vectors b),
neighbours AS (SELECT a, b, round(s, 6) AS similarity, r FROM ranked WHERE r <= {TOP_K + 1} AND a <> b AND s >= {COSINE}),
similar_pairs AS (SELECT least(a, b) AS a, greatest(a, b) AS b, 'embedding' AS method, round(1 - max(similarity), 6) AS distance, max(similarity) AS similarity FROM neighbours GROUP BY least(a, b), greatest(a, b))"""


UNIT = "list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))))"
VECTORS = f"SELECT vec_id AS idx, {UNIT} AS v FROM embeddings"
DOC_VECTORS = f"SELECT vec_id AS idx, {UNIT} AS v FROM embeddings JOIN samples ON idx = vec_id WHERE NOT corrupt"
FINDINGS = f"""
candidates AS (SELECT * FROM exact UNION ALL SELECT * FROM near UNION ALL SELECT * FROM similar_pairs),
best AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY CASE method WHEN 'sha256' THEN 3 WHEN 'phash' THEN 2 ELSE 1 END DESC) AS n FROM candidates),
merged AS (SELECT b1.a, b1.b, b1.method, b1.distance, b1.similarity, m.methods FROM best b1 JOIN (SELECT a, b, list_sort(list(DISTINCT method)) AS methods FROM candidates GROUP BY a, b) m USING (a, b) WHERE n = 1),
sided AS (SELECT m.*, x.sample_id AS sample_a, y.sample_id AS sample_b, x.split AS split_a, y.split AS split_b, x.label AS class_a, y.label AS class_b, x.split <> y.split AS cross_split,
  x.label <> y.label AND x.label <> '{M.UNLABELED}' AND y.label <> '{M.UNLABELED}' AS conflicting_label, m.method = 'sha256' OR (m.method = 'phash' AND m.distance <= {STRONG}) AS strong
  FROM merged m JOIN samples x ON x.idx = m.a JOIN samples y ON y.idx = m.b),
findings AS (SELECT 'f_' || a || '_' || b AS finding_id,
  CASE WHEN conflicting_label AND strong THEN '{M.CONFLICT}' WHEN cross_split AND method = 'sha256' THEN '{M.EXACT_CROSS}' WHEN cross_split AND method = 'phash' THEN '{M.NEAR_CROSS}'
    WHEN method = 'embedding' THEN '{M.SEMANTIC}' ELSE '{M.REDUNDANT}' END AS kind,
  CASE WHEN conflicting_label AND strong AND method = 'sha256' THEN 'critical' WHEN conflicting_label AND strong THEN 'high' WHEN cross_split AND method = 'sha256' THEN 'critical'
    WHEN cross_split AND method = 'phash' THEN (CASE WHEN strong THEN 'high' ELSE 'medium' END) WHEN cross_split THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN method = 'sha256' THEN '{M.CONFIRMED}' WHEN method = 'embedding' THEN '{M.POSSIBLE}' WHEN strong THEN '{M.LIKELY}' ELSE '{M.NEEDS_REVIEW}' END AS confidence_label,
  method, a AS a_idx, b AS b_idx, sample_a, sample_b, split_a, split_b, class_a, class_b, distance, similarity, cross_split, conflicting_label, methods FROM sided)"""
REVIEWS = """
reviews AS (SELECT finding_id, CASE (a_idx + b_idx) % 7 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'safe' WHEN 2 THEN 'uncertain' END AS decision FROM findings WHERE (a_idx + b_idx) % 7 < 3)"""
ALL = ",".join([SAMPLES, PRINTS, EXACT, NEARS, similar_sql(DOC_VECTORS), FINDINGS, REVIEWS])
TOTALS = """
class_counts AS (SELECT label, count(*) AS n FROM samples WHERE NOT corrupt GROUP BY label),
totals AS (SELECT count(*) AS total, count(*) FILTER (NOT corrupt) AS valid, count(*) FILTER (corrupt) AS corrupt, count(*) FILTER (NOT corrupt AND split = 'test') AS test,
  (SELECT count(*) FROM class_counts) AS classes, (SELECT round(max(n) / min(n), 3) FROM class_counts) AS class_imbalance_ratio,
  round(coalesce(count(*) FILTER (NOT corrupt AND split = 'test') / nullif(count(*) FILTER (NOT corrupt), 0), 0), 4) AS test_fraction FROM samples)"""
SCORE = f"""
hit AS (SELECT kind, count(DISTINCT idx) AS n FROM (SELECT kind, a_idx AS idx FROM findings UNION ALL SELECT kind, b_idx FROM findings) GROUP BY kind),
weights AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{c}', {w}::DOUBLE, {'NULL' if s is None else s}::DOUBLE)" for i, (c, (w, s)) in enumerate(M.PENALTIES.items()))}) t(position, category, weight, saturation)),
counted AS (SELECT w.*, t.*, CAST(CASE category WHEN '{M.CORRUPT}' THEN t.corrupt WHEN '{M.CLASS_IMBALANCE}' THEN t.classes WHEN '{M.SPLIT_IMBALANCE}' THEN t.test ELSE coalesce(h.n, 0) END AS BIGINT) AS affected_samples
  FROM weights w LEFT JOIN hit h ON h.kind = w.category, totals t),
parts AS (SELECT CAST(position AS INT) AS position, category, weight, affected_samples,
  CASE category WHEN '{M.CLASS_IMBALANCE}' THEN round(class_imbalance_ratio, 4) WHEN '{M.SPLIT_IMBALANCE}' THEN test_fraction ELSE round(affected_samples / greatest(1, valid), 6) END AS rate, saturation,
  round(weight * CASE category WHEN '{M.CLASS_IMBALANCE}' THEN least(1, greatest(0, (class_imbalance_ratio - 2) / 8))
    WHEN '{M.SPLIT_IMBALANCE}' THEN (CASE WHEN test = 0 OR test_fraction < 0.05 THEN 1 WHEN test_fraction < 0.10 THEN (0.10::DOUBLE - test_fraction) / (0.10::DOUBLE - 0.05::DOUBLE) WHEN test_fraction > 0.40 THEN least(1, (test_fraction - 0.40::DOUBLE) / 0.3::DOUBLE) ELSE 0 END)
    ELSE least(1, affected_samples / greatest(1, valid) / saturation) END, 3) AS penalty FROM counted)"""


def reach(edges: str) -> str:
    """Components of an edge list (a, b) by the smallest node reached."""
    return f"""
edges AS ({edges}),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
walk AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT walk.node, b FROM walk JOIN both_ways ON walk.seen = both_ways.a),
parts_of AS (SELECT node, min(seen) AS component FROM walk GROUP BY node),
grouped AS (SELECT node, component, 'g' || lpad(CAST(dense_rank() OVER (ORDER BY component) - 1 AS VARCHAR), 4, '0') AS group_id FROM parts_of)"""


REPAIR_EDGES = f"SELECT a_idx AS a, b_idx AS b FROM findings LEFT JOIN reviews USING (finding_id) WHERE coalesce(decision, '') <> 'safe' AND (kind <> '{M.SEMANTIC}' OR decision = 'confirmed')"
REPAIR = f"""
conflicts AS (SELECT DISTINCT a_idx AS idx FROM findings LEFT JOIN reviews USING (finding_id) WHERE kind = '{M.CONFLICT}' AND coalesce(decision, '') <> 'safe'),
group_rows AS (SELECT g.component, g.group_id, s.*, c.idx IS NOT NULL AS hit FROM grouped g JOIN samples s ON s.idx = g.node LEFT JOIN conflicts c ON c.idx = g.node),
group_counts AS (SELECT component, group_id, count(*) AS n, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test,
  bool_or(hit) AS conflicted, arg_min(split, idx) AS first_split, count(DISTINCT split) AS n_splits FROM group_rows GROUP BY ALL),
plans AS (SELECT *, CASE WHEN conflicted THEN 'excluded' WHEN n_splits = 1 THEN first_split WHEN test > n - test THEN 'test' WHEN train > 0 THEN 'train' ELSE first_split END AS target,
  CASE WHEN conflicted THEN '{R.WHY_CONFLICT}' WHEN n_splits = 1 THEN '{R.WHY_SINGLE}' WHEN test > n - test THEN '{R.WHY_TEST}' ELSE '{R.WHY_TRAIN}' END AS reason FROM group_counts),
entries AS (SELECT s.idx, s.sample_id, s.split AS original_split, s.label,
  CASE WHEN s.corrupt THEN 'excluded' WHEN p.target IS NULL THEN s.split ELSE p.target END AS proposed_split, CASE WHEN NOT s.corrupt THEN g.group_id END AS group_id,
  CASE WHEN s.corrupt THEN 'exclude' WHEN p.target IS NULL THEN 'keep' WHEN p.target = 'excluded' THEN 'exclude' WHEN p.target = s.split THEN 'keep' ELSE 'move' END AS action,
  CASE WHEN s.corrupt THEN 'Corrupt or unreadable image (too short).' WHEN p.target IS NULL THEN '{R.WHY_ALONE}' WHEN p.target = 'excluded' THEN '{R.WHY_AMBIGUOUS}' WHEN p.target = s.split THEN '{R.WHY_IN_PLACE}' ELSE p.reason END AS reason
  FROM samples s LEFT JOIN grouped g ON g.node = s.idx LEFT JOIN plans p USING (component))"""
WITH_REPAIR = ALL + "," + reach(REPAIR_EDGES) + "," + REPAIR


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def over(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"


#: The audits of running sessions, by session and folder.
_audits: dict[tuple[str, str], Audit] = {}


def audit(spark: SparkSession, sf_dir: str) -> Audit:
    """An audit of documents by all three searches, with made reviews. One session has one for each folder: findings are searched once, whatever is
    asked of them."""
    key = spark._jsparkSession.sessionUUID(), sf_dir
    if key not in _audits:
        found = class_audit(spark, sf_dir)
        _audits[key] = found.with_reviews(T.made_reviews(found.pairs))
    return _audits[key]


def class_audit(spark: SparkSession, sf_dir: str) -> Audit:
    """An audit of documents before any pair has been made: what classes can tell is told by them."""
    samples = T.document_samples(spark, sf_dir, embeddings=True)
    return Audit(samples, M.AuditConfig(phash_threshold=NEAR, phash_strong_threshold=STRONG, semantic_top_k=TOP_K, semantic_threshold=COSINE))


# ---- paths, predicates ----

#: Paths of every kind; # is a document's number.
PATH_CASES = [
    "train/cat/#.jpg", "Dataset\\Training\\dog\\a #.PNG", "images/val/x#.webp", "dev/x/y/#.jpeg", "#.jpg", "foo/bar/#.jpg", "./test/./q/#.png",
        "eval/#.png", "train/test/c/#.jpg", "../train/c/#.jpg",
    "/etc/passwd#", "c:/train/x/#.jpg", "", "train//c//#.jpg", "validation/(unlabeled)/#.png", "TESTING/A/#.JPG", "train/.hidden#", "train/._#.jpg",
        "__MACOSX/train/#.jpg", "train/c#/",
    "train/c/#.tar.gz", "train/c/#", "train/#/.DS_Store", "a/..#/train/b/1.png", "train/c/..", "..\\train\\c\\#.png", "\\train\\c\\#.png",
]


@query(f"""
WITH cases AS (SELECT doc_id AS n, replace(c, '#', CAST(doc_id AS VARCHAR)) AS path FROM documents JOIN (VALUES {", ".join(f"({i}, '{p}')" for i, p in enumerate(PATH_CASES))}) t(k, c) ON k = doc_id % {len(PATH_CASES)}),
parts AS (SELECT n, path, list_filter(string_split(replace(path, chr(92), '/'), '/'), lambda p: p <> '' AND p <> '.') AS p FROM cases),
folders AS (SELECT n, path, CASE WHEN len(p) > 0 THEN p[1:len(p)-1] ELSE [] END AS f FROM parts),
named AS (SELECT n, path, f, list_transform(f, lambda x: CASE WHEN lower(x) IN ('train','training') THEN 'train' WHEN lower(x) IN ('val','valid','validation','dev') THEN 'val' WHEN lower(x) IN ('test','testing','eval') THEN 'test' ELSE '' END) AS k FROM folders),
found AS (SELECT *, (list_filter(range(1, len(k) + 1), lambda i: k[i] <> ''))[1] AS pos FROM named)
SELECT n AS doc_id, path, CASE WHEN pos IS NOT NULL THEN k[pos] END AS split, CASE WHEN pos IS NULL THEN NULL WHEN pos = len(f) THEN '{M.UNLABELED}' ELSE array_to_string(f[pos+1:], '/') END AS label,
  path <> '' AND NOT starts_with(replace(path, chr(92), '/'), '/') AND coalesce(substr(path, 2, 1), '') <> ':' AND NOT list_contains(string_split(replace(path, chr(92), '/'), '/'), '..') AS safe,
  CASE WHEN path LIKE '%/' THEN 'directory' WHEN starts_with(string_split(path, '/')[-1], '._') OR string_split(path, '/')[-1] = '.DS_Store' THEN 'macOS resource fork'
    WHEN contains(path, '__MACOSX/') THEN 'macOS metadata' WHEN starts_with(string_split(path, '/')[-1], '.') THEN 'hidden file' END AS skip_reason FROM found""")
def classify_path_cases(spark, sf_dir):
    """Split, label and safety of a path for each document; the paths are of all kinds by turns."""
    case = F.get(F.array(*map(F.lit, PATH_CASES)), (F.col("doc_id") % len(PATH_CASES)).cast("int"))
    rows = T.read(spark, sf_dir, "documents").select("doc_id", F.replace(case, F.lit("#"), F.col("doc_id").cast("string")).alias("path"))
    place = paths.classify_path(F.col("path"))
    skip = paths.skip_reason(F.col("path"))
    return rows.select("doc_id", "path", place["split"].alias("split"), place["label"].alias("label"), paths.safe_member_name(F.col("path")).alias("safe"),
        skip.alias("skip_reason"))


@query("""
SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, CASE WHEN starts_with(lower(html), '<!doctype html') THEN 'HTML' END AS format,
  CAST(strlen(html) AS BIGINT) AS bytes, sha256(html) AS sha256 FROM pages""")
def sniff_pages(spark, sf_dir):
    p = T.read(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"),
        F.when(F.lower(F.substring("html", 1, 14)) == "<!doctype html", "HTML").alias("format"), F.octet_length("html").cast("bigint").alias("bytes"),
        F.sha2("html", 256).alias("sha256"))


HEADS = ["FFD8FFE0", "89504E470D0A1A0A", "52494646000000005745425056503820", "524946460000000057415645", "474946383961", ""]


@query(f"""SELECT doc_id, CASE doc_id % {len(HEADS)} WHEN 0 THEN 'JPEG' WHEN 1 THEN 'PNG' WHEN 2 THEN 'WEBP' END AS format FROM documents""")
def sniff_documents(spark, sf_dir):
    """The formats that leading bytes tell; every document's text has the head of one kind or another before it."""
    head = F.get(F.array(*map(F.lit, HEADS)), (F.col("doc_id") % len(HEADS)).cast("int"))
    content = F.concat(F.unhex(head), F.coalesce("text", F.lit("")).cast("binary"))
    return T.read(spark, sf_dir, "documents").select("doc_id", paths.sniff_format(content).alias("format"))


def document_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as the directory of an archive: paths of every kind, sizes, packed sizes and file modes by doc_id."""
    i, name, source = F.col("doc_id"), F.col("doc_id").cast("string"), F.col("source")
    said = [
        F.concat(F.lit("train/"), source, F.lit("/"), name, F.lit(".jpg")), F.concat(F.lit("Data\\Training\\"), source, F.lit("\\"), name, F.lit(".PNG")),
        F.concat(F.lit("images/val/"), source, F.lit("/"), name, F.lit(".webp")), F.concat(F.lit("dev/x/"), source, F.lit("/"), name, F.lit(".jpeg")),
        F.concat(F.lit("../train/"), source, F.lit("/"), name, F.lit(".jpg")), F.concat(F.lit("test/c/._"), name, F.lit(".jpg")),
            F.concat(F.lit("test/c/"), name, F.lit(".txt")),
        F.concat(F.lit("__MACOSX/test/"), name, F.lit(".png")), F.concat(F.lit("misc/"), name, F.lit(".png")),
    ]
    size = F.octet_length("text").cast("bigint")
    packed = F.greatest(F.lit(1), F.floor(size / (1 + i % 300)))
    mode = F.when(i % 11 == 0, 0o120777).otherwise(0o100644).cast("bigint")
    return T.read(spark, sf_dir, "documents").select("doc_id", F.get(F.array(*said), (i % 9).cast("int")).alias("path"), mode.alias("mode"),
        size.alias("size"), packed.alias("packed"))


MEMBER_BYTES = 4000


@query(f"""
WITH d AS (SELECT doc_id, doc_id % 9 AS k, source, CAST(strlen(text) AS BIGINT) AS size, CASE WHEN doc_id % 11 = 0 THEN {0o120777} ELSE {0o100644} END AS mode FROM documents),
e AS (SELECT *, greatest(1, size // (1 + doc_id % 300)) AS packed,
  CASE k WHEN 0 THEN 'train/' || source || '/' || doc_id || '.jpg' WHEN 1 THEN 'Data' || chr(92) || 'Training' || chr(92) || source || chr(92) || doc_id || '.PNG'
    WHEN 2 THEN 'images/val/' || source || '/' || doc_id || '.webp' WHEN 3 THEN 'dev/x/' || source || '/' || doc_id || '.jpeg'
    WHEN 4 THEN '../train/' || source || '/' || doc_id || '.jpg' WHEN 5 THEN 'test/c/._' || doc_id || '.jpg'
    WHEN 6 THEN 'test/c/' || doc_id || '.txt' WHEN 7 THEN '__MACOSX/test/' || doc_id || '.png' ELSE 'misc/' || doc_id || '.png' END AS path FROM d),
f AS (SELECT *, string_split(path, '/')[-1] AS base, list_filter(string_split(replace(path, chr(92), '/'), '/'), lambda p: p <> '' AND p <> '.') AS parts, size / packed AS ratio FROM e),
g AS (SELECT *, lower(regexp_extract(base, '[^.](\\.[^.]+)$', 1)) AS ext,
  list_transform(parts[1:len(parts)-1], lambda x: CASE WHEN lower(x) IN ('train','training') THEN 'train' WHEN lower(x) IN ('val','valid','validation','dev') THEN 'val'
    WHEN lower(x) IN ('test','testing','eval') THEN 'test' ELSE '' END) AS named FROM f),
h AS (SELECT *, (list_filter(range(1, len(named) + 1), lambda i: named[i] <> ''))[1] AS pos FROM g)
SELECT doc_id, path, CASE WHEN starts_with(base, '._') THEN 'macOS resource fork' WHEN contains(path, '__MACOSX/') THEN 'macOS metadata' END AS skip_reason,
  CASE WHEN list_contains(string_split(path, '/'), '..') THEN '{A.UNSAFE}' WHEN (mode >> 12) & 15 NOT IN (0, 8) THEN '{A.NON_REGULAR}'
    WHEN ext NOT IN ('.jpg', '.jpeg', '.png', '.webp') THEN 'Unsupported extension ' || chr(39) || ext || chr(39)
    WHEN size > {MEMBER_BYTES} THEN '{A.TOO_LARGE}' WHEN ratio > 200 THEN printf('Suspicious compression ratio (%.0fx)', ratio) END AS reject_reason,
  CASE WHEN pos IS NOT NULL THEN named[pos] END AS split,
  CASE WHEN pos IS NULL THEN NULL WHEN pos = len(named) THEN '{M.UNLABELED}' ELSE array_to_string(parts[pos+1:len(parts)-1], '/') END AS label FROM h""")
def ingest_guards(spark, sf_dir):
    place = paths.classify_path(F.col("path"))
    reject = A.reject_reason(M.Limits(member_bytes=MEMBER_BYTES))
    return document_entries(spark, sf_dir).select("doc_id", "path", paths.skip_reason(F.col("path")).alias("skip_reason"), reject.alias("reject_reason"),
        place["split"].alias("split"), place["label"].alias("label"))


@query(over(SAMPLES, "SELECT * FROM samples"))
def stored_samples(spark, sf_dir):
    """Samples stored for two jobs, one of them twice: what one job reads back."""
    root = fresh_path(spark, "stored-audit")
    own = T.document_samples(spark, sf_dir, fingerprints=False).select("idx", "sample_id", "split", "label", "sha256", "bytes", "width", "height",
        "img_format", "corrupt")
    for job, rows in (("a", own.filter("corrupt")), ("b", own.filter("not corrupt")), ("a", own)):
        T.store(rows, root, "samples", job)
    return T.stored(spark, root, "samples", "a")


# ---- candidates ----


@query(over(SAMPLES, "SELECT sha256, count(*) AS n, min(idx) AS first_idx FROM samples WHERE NOT corrupt GROUP BY sha256 HAVING count(*) > 1"))
def exact_groups(spark, sf_dir):
    return C.exact_groups(T.document_samples(spark, sf_dir, fingerprints=False))


@query(over(SAMPLES + "," + EXACT, "SELECT * FROM exact"))
def exact_pairs(spark, sf_dir):
    return C.exact_pairs(T.document_samples(spark, sf_dir, fingerprints=False))


@query(over(SAMPLES, "SELECT n AS group_size, count(*) AS n_groups, count(*) FILTER (splits > 1) AS cross_split FROM (SELECT count(*) AS n, count(DISTINCT split) AS splits FROM samples WHERE NOT corrupt GROUP BY sha256 HAVING count(*) > 1) GROUP BY n"))
def exact_group_stats(spark, sf_dir):
    own = T.document_samples(spark, sf_dir, fingerprints=False).filter("not corrupt")
    groups = own.groupBy("sha256").agg(F.count("*").alias("group_size"), F.count_distinct("split").alias("splits")).filter("group_size > 1")
    return groups.groupBy("group_size").agg(F.count("*").alias("n_groups"), F.count_if(F.expr("splits > 1")).alias("cross_split"))


@query(over(PRINTS, "SELECT idx, lower(lpad(printf('%x', h), 16, '0')) AS fingerprint FROM prints"))
def simhash64(spark, sf_dir):
    d = T.read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("idx"), hashing.text_fingerprint(F.col("text")).alias("h")).filter("h is not null").select("idx",
        hashing.to_hex(F.col("h")).alias("fingerprint"))


@query(over(",".join([SAMPLES, PRINTS, NEARS]), "SELECT * FROM near"))
def hamming_pairs(spark, sf_dir):
    return C.hamming_pairs(T.document_samples(spark, sf_dir), NEAR)


@query(ORACLE_SQL["hamming_pairs"])
def hamming_pairs_banded(spark, sf_dir):
    return C.hamming_banded(T.document_samples(spark, sf_dir), NEAR)


@query(over(",".join([SAMPLES, PRINTS, NEARS]), "SELECT CAST(distance AS BIGINT) AS distance, count(*) AS n FROM near GROUP BY distance"))
def hamming_histogram(spark, sf_dir):
    return C.hamming_pairs(T.document_samples(spark, sf_dir), NEAR).groupBy(F.col("distance").cast("bigint").alias("distance")).agg(F.count("*").alias("n"))


@query(over(similar_sql(VECTORS), "SELECT * FROM similar_pairs"))
def cosine_topk_pairs(spark, sf_dir):
    return C.cosine_pairs(T.vector_samples(spark, sf_dir), TOP_K, COSINE)


@query(over(similar_sql(VECTORS), "SELECT a, b, similarity, CAST(r AS INT) AS rank FROM neighbours"))
def cosine_neighbours(spark, sf_dir):
    return C.neighbours(T.vector_samples(spark, sf_dir), TOP_K, COSINE)


# ---- graph ----


@query(over(",".join([SAMPLES, PRINTS, NEARS, reach("SELECT a, b FROM near")]), "SELECT node, component, group_id FROM grouped"))
def components_all(spark, sf_dir):
    return G.groups(C.hamming_pairs(T.document_samples(spark, sf_dir), NEAR).select("a", "b"))


@query(over(",".join([SAMPLES, PRINTS, NEARS, reach("SELECT a, b FROM near")]), "SELECT component, count(*) AS n FROM grouped GROUP BY component"))
def component_sizes(spark, sf_dir):
    return G.components(C.hamming_pairs(T.document_samples(spark, sf_dir), NEAR).select("a", "b")).groupBy("component").agg(F.count("*").alias("n"))


# ---- findings ----

FLAT = ["finding_id", "kind", "severity", "confidence_label", "method", "a_idx", "b_idx", "sample_a", "sample_b", "split_a", "split_b", "class_a",
    "class_b", "distance", "similarity", "cross_split", "conflicting_label"]


@query(over(ALL, f"SELECT {', '.join(FLAT)} FROM findings"))
def findings_classified(spark, sf_dir):
    return audit(spark, sf_dir).findings.select(*FLAT)


@query(over(ALL, "SELECT a, b, method, distance, similarity FROM merged"))
def findings_merged(spark, sf_dir):
    return FD.merge(audit(spark, sf_dir).candidates).select("a", "b", "method", "distance", "similarity")


@query(over(ALL, "SELECT finding_id, array_to_string(methods, ',') AS methods, len(methods) > 1 AS corroborated FROM findings"))
def findings_corroboration(spark, sf_dir):
    d = F.col("detail")
    return audit(spark, sf_dir).findings.select("finding_id", F.array_join(d["methods"], ",").alias("methods"),
        d["corroborated_by_multiple_methods"].alias("corroborated"))


@query(over(ALL + "," + reach("SELECT a_idx AS a, b_idx AS b FROM findings"), """SELECT finding_id, kind, severity, confidence_label, method, sample_a, sample_b, split_a, split_b, class_a, class_b, distance, similarity,
  cross_split, conflicting_label, group_id, coalesce(decision, 'unreviewed') AS review_decision, '' AS review_note FROM findings JOIN grouped ON node = a_idx LEFT JOIN reviews USING (finding_id)"""))
def findings_csv(spark, sf_dir):
    a = audit(spark, sf_dir)
    return RP.findings_table(a.findings, a.decisions)


@query(over(ALL + "," + reach("SELECT a_idx AS a, b_idx AS b FROM findings"), "SELECT finding_id, group_id FROM findings JOIN grouped ON node = a_idx"))
def findings_grouped(spark, sf_dir):
    return audit(spark, sf_dir).findings.select("finding_id", "group_id")


@query(over(ALL, f"SELECT CAST(position AS INT) AS position, k.kind, count(f.kind) AS n FROM (VALUES {', '.join(f'({i}, {k!r})' for i, k in enumerate(M.PAIR_KINDS))}) k(position, kind) LEFT JOIN findings f ON f.kind = k.kind GROUP BY ALL"))
def findings_by_kind(spark, sf_dir):
    return FD.counts_by(audit(spark, sf_dir).findings, "kind", M.PAIR_KINDS)


@query(over(ALL, f"SELECT CAST(position AS INT) AS position, k.severity, count(f.severity) AS n FROM (VALUES {', '.join(f'({i}, {k!r})' for i, k in enumerate(M.SEVERITIES))}) k(position, severity) LEFT JOIN findings f ON f.severity = k.severity GROUP BY ALL"))
def findings_by_severity(spark, sf_dir):
    return FD.counts_by(audit(spark, sf_dir).findings, "severity", M.SEVERITIES)


@query(over(ALL, "SELECT finding_id, class_a, class_b, method FROM findings WHERE conflicting_label"))
def labels_conflict_pairs(spark, sf_dir):
    return audit(spark, sf_dir).findings.filter("conflicting_label").select("finding_id", "class_a", "class_b", "method")


@query(over(ALL, "SELECT least(split_a, split_b) AS split_1, greatest(split_a, split_b) AS split_2, count(*) AS n FROM findings GROUP BY ALL"))
def cross_split_matrix(spark, sf_dir):
    return FD.cross_split_matrix(audit(spark, sf_dir).findings)


REVIEWED = "SELECT f.*, coalesce(r.decision, 'unreviewed') AS review_decision FROM findings f LEFT JOIN reviews r USING (finding_id)"


@query(over(ALL, f"SELECT finding_id, severity, review_decision FROM ({REVIEWED}) WHERE least(split_a, split_b) = 'test' AND greatest(split_a, split_b) = 'train' AND (class_a = 'src0' OR class_b = 'src0' OR severity = 'high') AND severity = 'high' AND review_decision = 'unreviewed'"))
def findings_filtered(spark, sf_dir):
    a = audit(spark, sf_dir)
    return FindingsQuery(severity="high", split_pair="train-test", review="unreviewed").filtered(a.findings, a.decisions).select("finding_id", "severity",
        "review_decision")


@query(over(ALL, f"SELECT finding_id, severity, similarity, review_decision FROM ({REVIEWED}) ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, similarity DESC, a_idx, b_idx LIMIT 24 OFFSET 24"))
def findings_page(spark, sf_dir):
    a = audit(spark, sf_dir)
    return FindingsQuery(page=2).rows(a.pairs, a.decisions).select("finding_id", "severity", "similarity", "review_decision")


@query(over(ALL, f"SELECT finding_id, review_decision, x.bytes AS bytes_a, y.bytes AS bytes_b, x.corrupt AS corrupt_a FROM (SELECT * FROM ({REVIEWED}) ORDER BY similarity DESC, a_idx, b_idx LIMIT 24) p JOIN samples x ON x.idx = p.a_idx JOIN samples y ON y.idx = p.b_idx"))
def findings_page_samples(spark, sf_dir):
    a = audit(spark, sf_dir)
    page = FindingsQuery(sort="similarity").with_samples(a.pairs, a.decisions, a.samples)
    return page.select("finding_id", "review_decision", F.col("side_a.bytes").alias("bytes_a"), F.col("side_b.bytes").alias("bytes_b"),
        F.col("side_a.corrupt").alias("corrupt_a"))


@query(over(ALL, f"SELECT finding_id, kind, review_decision FROM ({REVIEWED})"))
def findings_with_reviews(spark, sf_dir):
    a = audit(spark, sf_dir)
    return RV.joined(a.findings, a.decisions).select("finding_id", "kind", "review_decision")


@query(over(ALL, "SELECT count(*) FILTER (decision = 'confirmed') AS confirmed, count(*) FILTER (decision = 'safe') AS safe, count(*) FILTER (decision = 'uncertain') AS uncertain FROM reviews"))
def review_counts(spark, sf_dir):
    return RV.counts(audit(spark, sf_dir).decisions)


LOG = "SELECT user_id AS finding_id, CASE event_type WHEN 'view' THEN 'unreviewed' WHEN 'click' THEN 'confirmed' WHEN 'signup' THEN 'safe' ELSE 'uncertain' END AS decision, ts AS updated_at FROM events"


@query(f"WITH log AS ({LOG}) SELECT CAST(finding_id AS VARCHAR) AS finding_id, decision FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY updated_at DESC) AS n FROM log) WHERE n = 1 AND decision <> 'unreviewed'")
def latest_reviews(spark, sf_dir):
    e = T.read(spark, sf_dir, "events")
    decision = F.when(F.col("event_type") == "view", "unreviewed").when(F.col("event_type") == "click", "confirmed").when(F.col("event_type") == "signup",
        "safe").otherwise("uncertain")
    return RV.current(e.select(F.col("user_id").cast("string").alias("finding_id"), decision.alias("decision"),
        F.col("ts").alias("updated_at"))).select("finding_id", "decision")


# ---- inventory, issues, score ----


@query(over(SAMPLES, "SELECT split, label, count(*) AS n FROM samples WHERE NOT corrupt GROUP BY GROUPING SETS ((split), (label), (split, label))"))
def inventory_split_class(spark, sf_dir):
    return I.split_class(T.document_samples(spark, sf_dir, fingerprints=False))


@query(over(SAMPLES, """SELECT measure, round(min(v), 4) AS min, round(quantile_cont(v, 0.25), 4) AS p25, round(quantile_cont(v, 0.5), 4) AS median, round(quantile_cont(v, 0.75), 4) AS p75, round(max(v), 4) AS max FROM (
  SELECT 'width' AS measure, CAST(width AS DOUBLE) AS v FROM samples WHERE NOT corrupt AND width <> 0 UNION ALL SELECT 'height', CAST(height AS DOUBLE) FROM samples WHERE NOT corrupt AND height <> 0
  UNION ALL SELECT 'aspect_ratio', round(CAST(width AS DOUBLE) / height, 4) FROM samples WHERE NOT corrupt AND height <> 0 AND width <> 0 UNION ALL SELECT 'file_size_bytes', CAST(bytes AS DOUBLE) FROM samples WHERE NOT corrupt AND bytes <> 0) GROUP BY measure"""))
def inventory_percentiles(spark, sf_dir):
    return I.percentiles(T.document_samples(spark, sf_dir, fingerprints=False))


@query(over(SAMPLES + "," + TOTALS, "SELECT total, valid, corrupt, test, classes, class_imbalance_ratio, test_fraction FROM totals"))
def inventory_totals(spark, sf_dir):
    return I.totals(T.document_samples(spark, sf_dir, fingerprints=False))


@query(over(SAMPLES, "SELECT img_format, count(*) AS n FROM samples WHERE NOT corrupt GROUP BY img_format"))
def format_histogram(spark, sf_dir):
    return I.formats(T.document_samples(spark, sf_dir, fingerprints=False))


@query(over(SAMPLES, "SELECT idx, sample_id, split, label, 'too short' AS error FROM samples WHERE corrupt"))
def corrupt_listing(spark, sf_dir):
    return I.corrupt_samples(T.document_samples(spark, sf_dir, fingerprints=False))


@query(over(SAMPLES + "," + TOTALS, "SELECT classes, class_imbalance_ratio, test_fraction FROM totals"))
def class_imbalance(spark, sf_dir):
    return I.class_balance(T.document_samples(spark, sf_dir, fingerprints=False))


SMALL = "WITH samples AS (SELECT doc_id, CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 = 7 THEN 'val' ELSE 'test' END AS split, source || '/' || CAST(doc_id % 13 AS VARCHAR) AS label, n_chars < 20 AS corrupt FROM documents)"


@query(f"{SMALL} SELECT s.split, c.label FROM (SELECT DISTINCT split FROM samples WHERE NOT corrupt) s, (SELECT DISTINCT label FROM samples WHERE NOT corrupt) c WHERE NOT EXISTS (SELECT 1 FROM samples x WHERE NOT corrupt AND x.split = s.split AND x.label = c.label)")
def missing_class_split(spark, sf_dir):
    s = T.document_samples(spark, sf_dir, fingerprints=False)
    return I.missing_classes(s.withColumn("label", F.concat_ws("/", "label", (F.col("idx") % 13).cast("string"))))


@query(over(SAMPLES, "SELECT sha256(string_agg(line, chr(10) ORDER BY line) || chr(10)) AS fingerprint FROM (SELECT split || '/' || label || '/' || sha256 AS line FROM samples)"))
def dataset_fingerprint(spark, sf_dir):
    return I.fingerprint(T.document_samples(spark, sf_dir, fingerprints=False))


@query(over(SAMPLES, f"""SELECT sha256(string_agg(leaf || ' ' || digest || chr(10), '' ORDER BY leaf)) AS merkle_root, count(*) AS leaves FROM (
  SELECT left(sha256(line), {I.LEAF_DIGITS}) AS leaf, sha256(string_agg(n || ' ' || line || chr(10), '' ORDER BY line)) AS digest FROM (
    SELECT split || '/' || label || '/' || sha256 AS line, count(*) AS n FROM samples GROUP BY line) GROUP BY leaf)"""))
def dataset_merkle_root(spark, sf_dir):
    return I.merkle_root(T.document_samples(spark, sf_dir, fingerprints=False))


@query(over(SAMPLES + "," + TOTALS + ", missing AS (SELECT count(*) AS m FROM (SELECT DISTINCT split FROM samples WHERE NOT corrupt) s, (SELECT DISTINCT label FROM samples WHERE NOT corrupt) c WHERE NOT EXISTS (SELECT 1 FROM samples x WHERE NOT corrupt AND x.split = s.split AND x.label = c.label))", f"""
SELECT 'issue_corrupt' AS issue_id, '{M.CORRUPT}' AS kind, 'medium' AS severity, CAST(corrupt AS VARCHAR) || ' corrupt or unreadable image(s)' AS title FROM totals WHERE corrupt > 0
UNION ALL SELECT 'issue_class_imbalance', '{M.CLASS_IMBALANCE}', CASE WHEN class_imbalance_ratio >= 5 THEN 'medium' ELSE 'low' END, printf('Class imbalance ratio %.1fx (largest class / smallest class)', class_imbalance_ratio) FROM totals WHERE class_imbalance_ratio > 2
UNION ALL SELECT 'issue_no_test_split', '{M.SPLIT_IMBALANCE}', 'medium', 'No test split detected' FROM totals WHERE test = 0
UNION ALL SELECT 'issue_split_imbalance', '{M.SPLIT_IMBALANCE}', 'low', printf('Test split is %.1f%% of the dataset', test_fraction * 100) FROM totals WHERE test > 0 AND (test_fraction < 0.05 OR test_fraction > 0.40)
UNION ALL SELECT 'issue_missing_classes', '{M.CLASS_IMBALANCE}', 'low', CAST(m AS VARCHAR) || ' class/split combination(s) empty' FROM missing WHERE m > 0"""))
def dataset_issues(spark, sf_dir):
    return I.issues(T.document_samples(spark, sf_dir, fingerprints=False))


@query(over(SAMPLES, "SELECT label, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM samples WHERE NOT corrupt GROUP BY label"))
def split_class_chart(spark, sf_dir):
    return I.split_class_chart(T.document_samples(spark, sf_dir, fingerprints=False))


@query(over(ALL + "," + TOTALS + "," + SCORE, "SELECT kind, n AS affected_samples FROM hit"))
def affected_samples(spark, sf_dir):
    return FD.affected(audit(spark, sf_dir).findings)


@query(over(ALL + "," + TOTALS + "," + SCORE, "SELECT * FROM parts"))
def score_components(spark, sf_dir):
    return audit(spark, sf_dir).score_components()


@query(over(ALL + "," + TOTALS + "," + SCORE, """SELECT round(greatest(0, least(100, 100 - t)), 1) AS score, CASE WHEN 100 - t >= 90 THEN 'Low risk' WHEN 100 - t >= 75 THEN 'Moderate risk' WHEN 100 - t >= 50 THEN 'High risk' ELSE 'Severe risk' END AS grade,
  round(t, 3) AS total_penalty FROM (SELECT sum(penalty ORDER BY position) AS t FROM parts)"""))
def integrity_score(spark, sf_dir):
    return audit(spark, sf_dir).score()


@query(over(ALL.replace("findings AS (SELECT", "all_findings AS (SELECT")
    .replace("FROM findings", "FROM all_findings") + ", findings AS (SELECT * FROM all_findings WHERE finding_id NOT IN (SELECT finding_id FROM reviews WHERE decision = 'safe'))," + TOTALS + "," + SCORE, "SELECT category, affected_samples, penalty FROM parts"))
def score_without_safe(spark, sf_dir):
    a = audit(spark, sf_dir)
    return a.score_components(a.decisions.filter("decision = 'safe'").select("finding_id")).select("category", "affected_samples", "penalty")


@query(over(ALL, "SELECT kind, severity, count(*) AS n FROM findings GROUP BY ALL"))
def class_counts(spark, sf_dir):
    """Findings by kind and severity, counted from classes: no pair is made."""
    return class_audit(spark, sf_dir).classes.counts()


@query(over(ALL + "," + TOTALS + "," + SCORE, "SELECT kind, n AS affected_samples FROM hit"))
def class_affected(spark, sf_dir):
    return class_audit(spark, sf_dir).classes.affected()


@query(over(ALL + "," + TOTALS + "," + SCORE, "SELECT * FROM parts"))
def class_score_components(spark, sf_dir):
    return class_audit(spark, sf_dir).score_components()


@query(over(ALL + "," + reach("SELECT a_idx AS a, b_idx AS b FROM findings"), "SELECT node, component, group_id FROM grouped"))
def class_components(spark, sf_dir):
    return G.groups(class_audit(spark, sf_dir).classes.edges())


@query(over(SAMPLES, """SELECT sha256, n, CAST(n * (n - 1) // 2 AS BIGINT) AS t FROM (SELECT sha256, count(*) AS n FROM samples WHERE NOT corrupt GROUP BY sha256 HAVING count(*) > 1)"""))
def exact_classes(spark, sf_dir):
    """A row for each digest of several samples, with the number of its pairs."""
    samples = T.document_samples(spark, sf_dir, fingerprints=False)
    rows = Classes(samples, NEAR, STRONG, near=False).classes
    return rows.join(samples.select(F.col("idx").alias("cls"), "sha256"), "cls").select("sha256", "n", "t")


@query(over(SAMPLES + "," + EXACT, "SELECT a, b, method, distance, similarity FROM exact"))
def exact_pairs_exported(spark, sf_dir):
    """All exact pairs, made from classes by their ranks."""
    return Classes(T.document_samples(spark, sf_dir, fingerprints=False), NEAR, STRONG, near=False).export()


@query(over(",".join([SAMPLES, PRINTS, "valid_prints AS (SELECT p.* FROM prints p JOIN samples s USING (idx) WHERE NOT s.corrupt)"]), f"""SELECT a.idx AS a, b.idx AS b, 'phash' AS method, CAST(bit_count(xor(a.h, b.h)) AS DOUBLE) AS distance, round(1 - bit_count(xor(a.h, b.h)) / 64.0::DOUBLE, 6) AS similarity
  FROM valid_prints a JOIN valid_prints b ON a.idx < b.idx AND bit_count(xor(a.h, b.h)) <= {WIDE}"""))
def hamming_pairs_wide(spark, sf_dir):
    """Pairs at a distance where one equal band tells little: bands with distances of their own."""
    return C.hamming_banded(T.document_samples(spark, sf_dir), WIDE)


# ---- repair ----


@query(over(WITH_REPAIR, "SELECT group_id, n, train, val, test, conflicted, target, reason FROM plans"))
def repair_groups(spark, sf_dir):
    return audit(spark, sf_dir).repair().groups.select("group_id", "n", *M.SPLITS, "conflicted", "target", "reason")


@query(over(WITH_REPAIR, "SELECT group_id, CAST(row_number() OVER (PARTITION BY component ORDER BY idx) - 1 AS BIGINT) AS position, idx, sample_id, split, label FROM group_rows"))
def repair_group_members(spark, sf_dir):
    a = audit(spark, sf_dir)
    return R.group_members(a.samples, a.repair().tied)


@query(over(WITH_REPAIR, "SELECT sample_id, original_split, proposed_split, label AS class, coalesce(group_id, '') AS group_id, action, reason FROM entries"))
def repair_csv(spark, sf_dir):
    return RP.repair_table(audit(spark, sf_dir).repair().entries)


@query(over(WITH_REPAIR, "SELECT * FROM entries"))
def repair_manifest(spark, sf_dir):
    return audit(spark, sf_dir).repair().entries.drop("rel_path")


@query(over(WITH_REPAIR, "SELECT count(*) FILTER (action = 'move') AS moves, count(*) FILTER (action = 'exclude') AS exclusions, count(*) FILTER (action = 'keep') AS kept FROM entries"))
def repair_counts(spark, sf_dir):
    return audit(spark, sf_dir).repair().counts


@query(over(WITH_REPAIR, "SELECT idx, action, proposed_split FROM entries WHERE action <> 'keep'"))
def repair_changes(spark, sf_dir):
    return R.changed(audit(spark, sf_dir).repair().entries).select("idx", "action", "proposed_split")


@query(over(WITH_REPAIR, f"""SELECT printf('Class ''%s'' would lose %d of %d test samples; consider sourcing fresh test data.', label, n - m, n) AS warning FROM (SELECT b.label, b.n, coalesce(a.m, 0) AS m FROM (SELECT label, count(*) AS n FROM samples WHERE split = 'test' GROUP BY label) b
  LEFT JOIN (SELECT label, count(*) AS m FROM entries WHERE proposed_split = 'test' GROUP BY label) a USING (label)) WHERE n >= 3 AND m < n * 0.5
  UNION ALL SELECT printf('%d unreviewed possible-overlap finding(s) were NOT grouped. Enable ''include uncertain matches'' or review them to include.', u) FROM (SELECT count(*) AS u FROM findings WHERE kind = '{M.SEMANTIC}' AND finding_id NOT IN (SELECT finding_id FROM reviews)) WHERE u > 0"""))
def repair_warnings(spark, sf_dir):
    return audit(spark, sf_dir).repair().warnings


@query(over(WITH_REPAIR, "SELECT coalesce(b.split, a.split) AS split, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM (SELECT split, count(*) AS n FROM samples GROUP BY split) b FULL JOIN (SELECT proposed_split AS split, count(*) AS n FROM entries WHERE proposed_split <> 'excluded' GROUP BY proposed_split) a ON a.split = b.split"))
def split_delta(spark, sf_dir):
    return audit(spark, sf_dir).repair().delta


@query(over(ALL, f"""SELECT CAST(position AS INT) AS position, kind, n FROM (SELECT CASE kind WHEN '{M.EXACT_CROSS}' THEN 1 WHEN '{M.CONFLICT}' THEN 2 WHEN '{M.NEAR_CROSS}' THEN 3 WHEN '{M.CORRUPT}' THEN 4 WHEN '{M.SEMANTIC}' THEN 5 END AS position, kind, n FROM
  (SELECT kind, count(*) AS n FROM findings GROUP BY kind UNION ALL SELECT '{M.CORRUPT}', count(*) FROM samples WHERE corrupt)) WHERE position IS NOT NULL AND n > 0"""))
def fix_first(spark, sf_dir):
    a = audit(spark, sf_dir)
    return FD.first_to_fix(a.findings, a.totals)


# ---- evaluation ----


@query("""WITH samples AS (SELECT vec_id, CASE WHEN vec_id % 10 < 7 THEN 'train' WHEN vec_id % 10 = 7 THEN 'val' ELSE 'test' END AS split, label FROM embeddings),
shared AS (SELECT label, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'test') AS test FROM samples GROUP BY label)
SELECT bool_and(train >= 5) AND count(*) >= 2 AND (SELECT count(*) FROM samples WHERE split = 'test') >= 10 AS eligible, 'Dataset is eligible for the diagnostic experiment.' AS reason FROM shared WHERE train > 0 AND test > 0""")
def eval_eligibility(spark, sf_dir):
    return E.eligibility(T.vector_samples(spark, sf_dir), M.AuditConfig())


@query(over(ALL, f"""SELECT idx, arg_min(finding_id, o) AS finding_id, arg_min(method, o) AS method, arg_min(confirmed, o) AS confirmed FROM (SELECT *, row_number() OVER (ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, similarity DESC, a_idx, b_idx) AS o FROM (
  SELECT f.*, coalesce(decision = 'confirmed', false) AS confirmed, unnest([a_idx, b_idx]) AS idx, unnest([split_a, split_b]) AS side FROM findings f LEFT JOIN reviews USING (finding_id)
  WHERE cross_split AND coalesce(decision, '') <> 'safe' AND (method = 'sha256' OR (method = 'phash' AND kind = '{M.NEAR_CROSS}' AND severity IN ('critical', 'high')) OR coalesce(decision = 'confirmed', false)))) WHERE side = 'test' GROUP BY idx"""))
def quarantine_set(spark, sf_dir):
    a = audit(spark, sf_dir)
    return E.quarantine(a.findings, a.decisions).select("idx", "finding_id", "method", "confirmed")


@query("""
WITH p AS (SELECT quality AS label, CAST(doc_id % 3 > 0 AS INT) AS prediction FROM labels WHERE doc_id % 10 >= 8),
classes AS (SELECT DISTINCT label AS c FROM p UNION SELECT DISTINCT prediction FROM p),
per AS (SELECT c, count(*) FILTER (label = c AND prediction = c) AS hit, count(*) FILTER (label = c) AS actual, count(*) FILTER (prediction = c) AS guess FROM p, classes GROUP BY c)
SELECT (SELECT count(*) FROM p) AS test_samples, round((SELECT avg(CAST(label = prediction AS INT)) FROM p), 9) AS accuracy, round(avg(2 * hit / (actual + guess)), 9) AS macro_f1 FROM per""")
def accuracy_f1(spark, sf_dir):
    p = T.read(spark, sf_dir, "labels").filter("doc_id % 10 >= 8").select(F.col("quality").alias("label"),
        (F.col("doc_id") % 3 > 0).cast("int").alias("prediction"))
    return E.accuracy(p).select("test_samples", F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"))


@query()
def eval_gap(spark, sf_dir):
    samples = T.vector_samples(spark, sf_dir)
    return Audit(samples, M.AuditConfig(enable_exact=False, enable_perceptual=False, semantic_threshold=COSINE)).evaluation()


@query()
def bootstrap_ci(spark, sf_dir):
    p = T.read(spark, sf_dir, "labels").filter("doc_id % 10 >= 8").select(F.col("doc_id").alias("idx"), F.col("quality").alias("label"),
        F.lit(1).alias("prediction"))
    return E.bootstrap(p, M.AuditConfig(), 1337)


# ---- jobs ----


def moment(ts: str) -> F.Column:
    """Times as text, which both engines write alike."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(ts)


WRITTEN = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


@query(f"""SELECT user_id AS job_id, arg_max(event_type, (ts, event_id)) AS stage, arg_max(event_id, (ts, event_id)) AS event_id, {WRITTEN.format("min(ts)")} AS created_at, {WRITTEN.format("max(ts)")} AS updated_at, count(*) AS n_events FROM events GROUP BY user_id""")
def latest_job_state(spark, sf_dir):
    return J.latest_state(T.job_events(spark, sf_dir)).withColumns({c: moment(c) for c in ("created_at", "updated_at")})


EXPIRY = "TIMESTAMP '2024-01-02 12:00:00'"


@query(f"SELECT user_id AS job_id, {WRITTEN.format('min(ts)')} AS created_at FROM events GROUP BY user_id HAVING min(ts) + INTERVAL 24 HOUR < {EXPIRY}")
def expired_jobs(spark, sf_dir):
    now = F.lit("2024-01-02 12:00:00").cast("timestamp_ntz")
    return J.expired(J.latest_state(T.job_events(spark, sf_dir)), now).select("job_id", moment("created_at"))


STAGE_LIST = ", ".join(f"({i}, '{k}', '{label}')" for i, (k, label) in enumerate(M.STAGES))


@query(f"""WITH jobs AS (SELECT user_id AS job_id, count(*) % 10 AS pos FROM events GROUP BY user_id), stages AS (SELECT * FROM (VALUES {STAGE_LIST}) t(position, key, label))
SELECT job_id, CAST(position AS INT) AS position, key, label, CASE WHEN (pos >= 1 AND position > pos) OR pos = 9 THEN 'complete' WHEN position = pos THEN 'active' ELSE 'pending' END AS state FROM jobs, stages WHERE position > 0""")
def stage_progress(spark, sf_dir):
    jobs = T.job_events(spark, sf_dir).groupBy("job_id").agg((F.count("*") % 10).cast("int").alias("at"))
    names = F.array(*[F.lit(k) for k, _ in M.STAGES])
    jobs = jobs.select("job_id", F.get(names, F.col("at")).alias("stage"), F.when(F.col("at") == 9, "complete").otherwise("running").alias("status"))
    return J.stage_progress(jobs)


@query(f"SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events GROUP BY user_id HAVING min(ts) + INTERVAL 24 HOUR < {EXPIRY})")
def retained_events(spark, sf_dir):
    events = T.job_events(spark, sf_dir)
    gone = J.expired(J.latest_state(events), F.lit("2024-01-02 12:00:00").cast("timestamp_ntz"))
    return J.without(events, gone).select("event_id")


@query(f"SELECT user_id AS job_id, {WRITTEN.format('max(ts)')} AS seen_at FROM events GROUP BY user_id ORDER BY max(ts) DESC, job_id LIMIT 20")
def job_history(spark, sf_dir):
    return J.history(T.job_events(spark, sf_dir).select("job_id", F.col("ts").alias("seen_at"))).select("job_id", moment("seen_at"))
