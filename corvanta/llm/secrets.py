"""Secret scans with a random forest that removes false positives.

Candidates are long runs of token characters. Each is described by its length, the
changes between kinds of characters, how much of it dictionary words cover, its path
and the words before it. The forest is trained from labelled findings. The main path
is DataFrame operations and the JVM's own forest.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CANDIDATE = r"[A-Za-z0-9+/_=.~-]{16,}"
#: Characters before a candidate that count as its neighbouring words.
NEAR = 48

# Words and parts of words.
DICTIONARY = (
    "about access account after again align also answer application array background before begin border both button buffer build "
    "cache call change char class client code color commit common config connect content context control count create current data "
    "date debug default delete demo describe device document down edit element error event example export field file filter first "
    "font form from function global group hand handler hash header height hello here house image import index info input insert "
    "int item java json keyboard label language last left length level library light line link list local long main make manager "
    "memory message method model module month more name native network node none note number object offset open option order other "
    "output package page param parent path pattern person place player plugin point port position print process profile program "
    "project property public query random read record release remove replace report request reset resource response result return "
    "right role rule sample save schema screen script search select send server service session setting size sort source split "
    "stack start state status step stop storage store stream string style system table target task template test text thing this "
    "thread time title token total tree true type unit update upload user util value vector version view water where which while "
    "width window with word work world write your"
).split()
SECRET_WORDS = ("token", "secret", "password", "passwd", "api", "key", "auth", "bearer", "credential", "private", "access")
HARMLESS_WORDS = ("commit", "sha", "hash", "checksum", "digest", "uuid", "guid", "etag", "integrity", "revision", "example", "sample", "dummy", "test", "fake", "placeholder", "your", "version", "base64", "image", "http")
HARMLESS_PATHS = ("test", "example", "sample", "fixture", "doc", "mock", "lock")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "sk-", "AIza", "eyJ", "npm_", "pypi-")

#: A value of 6 or more token characters that is assigned to a name with a secret word in it.
ASSIGNED = r"(?i)(?:" + "|".join(SECRET_WORDS) + r")[A-Za-z0-9_.-]{0,32}[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9+/_=.~-]{6,})"

FEATURES = ["length", "transitions", "case_changes", "digit_share", "distinct_share", "hexadecimal", "covered", "longest_word", "prefix", "secret_near", "harmless_near", "assigned", "harmless_path", "harmless_inside"]


def _any(column: Column, words: tuple[str, ...]) -> Column:
    return column.rlike("|".join(words)).cast("double")


def with_features(findings: DataFrame) -> DataFrame:
    """``findings`` (candidate, before, path, ...) with the forest's features."""
    c = F.col("candidate")
    n = F.length(c).cast("double")
    small = F.lower(c)
    before, path = F.lower(F.coalesce("before", F.lit(""))), F.lower(F.coalesce("path", F.lit("")))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[A-Za-z]+", "a"), "[0-9]+", "0"), "[^a0]+", "-")
    cases = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z]+", ""), "[A-Z]+", "U"), "[a-z]+", "l")
    words = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    return (
        findings.withColumn("length", n)
        .withColumn("transitions", F.length(kinds) / n)
        .withColumn("case_changes", F.length(cases) / n)
        .withColumn("digit_share", F.length(F.regexp_replace(c, "[^0-9]", "")) / n)
        .withColumn("distinct_share", F.size(F.array_distinct(F.split(c, ""))) / n)
        .withColumn("hexadecimal", c.rlike("^[0-9a-fA-F]+$").cast("double"))
        .withColumn("covered", 1 - F.length(F.regexp_replace(small, words, "")) / n)
        .withColumn("longest_word", F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit("[A-Z]?[a-z]+"), F.lit(0)), F.length)), F.lit(0)) / n)
        .withColumn("prefix", c.rlike("^(" + "|".join(PREFIXES) + ")").cast("double"))
        .withColumn("secret_near", _any(before, SECRET_WORDS))
        .withColumn("harmless_near", _any(before, HARMLESS_WORDS))
        .withColumn("assigned", before.rlike(r"[=:]\s*[\"']?$").cast("double"))
        .withColumn("harmless_path", _any(path, HARMLESS_PATHS))
        .withColumn("harmless_inside", F.greatest(_any(small, ("example", "sample", "dummy", "placeholder", "your", "xxxx", "1234567", "abcdef")), c.rlike(r"(.)\1{5}").cast("double")))
    )


def _is_candidate(run: Column) -> Column:
    return (F.length(run) >= 16) & ((run.rlike("[0-9]") & run.rlike("[A-Za-z]")) | run.rlike("^(" + "|".join(PREFIXES) + ")"))


def _before(pieces: Column, found: Column, k: Column, back: int) -> Column:
    """The NEAR characters before match ``k`` of a text that is cut into ``pieces`` at matches ``found``, of which at most ``back`` others fit there."""
    tail = lambda x: F.coalesce(F.right(x, F.lit(NEAR)), F.lit(""))
    parts = [tail(F.get(pieces, k))]
    for n in range(1, back + 1):
        parts += [tail(F.get(found, k - n)), tail(F.get(pieces, k - n))]
    return F.right(F.concat(*reversed(parts)), F.lit(NEAR))


def find_candidates(df: DataFrame, text: str = "text", row_id: str = "doc_id", path: str | None = None) -> DataFrame:
    """A row for each place of a candidate in each row: doc_id, place, candidate, before, path.

    A candidate has 16 or more token characters, a digit and a letter among them or a
    known prefix; or 6 or more of any kind, assigned to a name with a secret word.
    ``place`` numbers a text's candidates, those that are only assigned values last;
    ``before`` are the characters before it there, so that each place is judged by its
    own neighbours. Null and empty texts have none; repeated rows have theirs each. Texts
    are read to their end, and a candidate takes its neighbours with it, not its text.
    """
    t = F.col("t")
    rows = df.select(F.col(row_id).alias("doc_id"), F.col(text).alias("t"), (F.col(path) if path else F.lit(None)).cast("string").alias("path"))
    rows = rows.withColumns({"runs": F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)), "assigned": F.regexp_extract_all(t, F.lit(ASSIGNED), F.lit(0))})
    rows = rows.where(F.exists("runs", _is_candidate) | (F.size("assigned") > 0))
    # Matches have 16 and 10 characters or more, with one between.
    rows = rows.withColumns({"between": F.split(t, CANDIDATE, -1), "apart": F.when(F.size("assigned") > 0, F.split(t, ASSIGNED, -1))})
    at = lambda pieces, found, back: lambda x, k: F.struct(x.alias("match"), _before(F.col(pieces), F.col(found), k, back).alias("before"))
    long_ = F.filter(F.transform("runs", at("between", "runs", 3)), lambda x: _is_candidate(x["match"]))
    long_ = F.transform(long_, lambda x: F.struct(x["match"].alias("candidate"), x["before"]))

    def value_of(x: Column) -> Column:
        value = F.regexp_extract(x["match"], ASSIGNED, 1)
        name = F.left(x["match"], F.length(x["match"]) - F.length(value))
        return F.struct(value.alias("candidate"), F.right(F.concat(x["before"], name), F.lit(NEAR)).alias("before"))

    short = F.transform(F.transform("assigned", at("apart", "assigned", 5)), value_of)
    # A value that is a run of its own is there already.
    short = F.filter(short, lambda x: ~(_is_candidate(x["candidate"]) & F.right(x["before"], F.lit(1)).rlike("[^A-Za-z0-9+/_=.~-]")))
    each = rows.select("doc_id", "path", F.posexplode(F.concat(long_, F.coalesce(short, F.array().cast("array<struct<candidate:string,before:string>>")))).alias("place", "c"))
    return each.select("doc_id", F.col("place").cast("long").alias("place"), "c.candidate", "c.before", "path")


def invented_findings(spark: SparkSession, rows: int = 6000, seed: int = 0) -> DataFrame:
    """Labelled findings (candidate, before, path, label) made from formats by rule.

    For use where no findings of one's own are labelled. Random parts are SHA-2 digests
    of the row number and ``seed``.
    """
    i = F.col("id") + F.lit(seed * 1_000_003)
    digest = F.sha2(i.cast("string"), 512)
    other = F.sha2(F.concat(F.lit("b"), i.cast("string")), 512)
    code = F.base64(F.unhex(other))
    plain = F.regexp_replace(code, "[+/=]", "7")
    word = lambda k: F.element_at(F.array(*map(F.lit, DICTIONARY)), (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(DICTIONARY))) + 1).cast("int"))
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(values))) + 1).cast("int"))
    name = pick(("token", "secret", "api_key", "apikey", "password", "auth_token", "access_key", "private_key", "client_secret", "credential"), "n")
    assign = pick((' = "', "=", ": ", ': "', " = '", " "), "a")
    secret_before = F.concat(word("w"), F.lit(" "), name, assign)
    harmless = pick(("commit ", "sha256:", "checksum ", "revision ", "etag: ", "uuid=", "hash ", "digest: "), "h")
    stretch = lambda s, a, b: s.substr(F.lit(1), F.lit(a) + F.pmod(F.xxhash64(i, F.lit("len")), F.lit(b - a + 1)).cast("int"))
    secrets = [
        (F.substring(digest, 1, 40), secret_before),
        (F.substring(digest, 1, 32), secret_before),
        (stretch(plain, 20, 44), secret_before),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(plain, 1, 16))), F.concat(word("w"), F.lit(" "))),
        (F.concat(F.lit("ghp_"), F.substring(plain, 1, 36)), F.concat(word("w"), assign)),
        (F.concat(F.lit("sk_live_"), F.substring(plain, 1, 24)), F.concat(word("w"), assign)),
        (stretch(plain, 8, 14), F.concat(name, pick((' = "', "=", ": ", ': "'), "a"))),
    ]
    others = [
        (F.substring(digest, 1, 40), F.concat(word("w"), F.lit(" "), harmless)),
        (F.substring(digest, 1, 64), F.concat(word("w"), F.lit(" "), harmless)),
        (F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4), F.substring(digest, 17, 4), F.substring(digest, 21, 12)), F.concat(word("w"), F.lit(" id="))),
        (F.concat_ws("_", word("1"), word("2"), word("3"), F.substring(digest, 1, 1)), F.concat(word("w"), F.lit(" "))),
        (F.concat(F.lit("YOUR_"), F.upper(name), F.lit("_EXAMPLE_1234567")), secret_before),
        (F.concat(F.repeat(F.substring(digest, 1, 1), 16), F.lit("0x")), secret_before),
        (F.concat_ws("/", F.lit("www.site" ), word("1"), word("2"), F.concat(word("3"), F.substring(digest, 1, 2))), F.lit("http://")),
        (stretch(code, 40, 80), F.lit("data:image/png;base64,")),
        (F.concat(word("1"), pick(("", "_", "."), "j"), word("2")), F.concat(name, pick((' = "', "=", ": ", ': "'), "a"))),
    ]
    path = pick(("src/main.py", "config/settings.yaml", "deploy/env", "app/server.js", "README"), "p")
    bad_path = pick(("tests/test_main.py", "docs/guide.md", "package-lock.json", "src/main.py", "README"), "p")
    cases = [(c, b, path, 1) for c, b in secrets] + [(c, b, bad_path, 0) for c, b in others]
    kind = F.pmod(F.col("id"), F.lit(len(cases))).cast("int")
    row = F.array(*[F.struct(c.alias("candidate"), b.alias("before"), p.alias("path"), F.lit(label).alias("label")) for c, b, p, label in cases])
    return spark.range(rows).select(F.get(row, kind).alias("r")).select("r.*")


def train_forest(findings: DataFrame, trees: int = 40, depth: int = 8, sample: int = 50_000, seed: int = 7) -> PipelineModel:
    """A forest of ``findings`` (candidate, before, path, label 0 or 1), of at most ``sample`` of them by hash.

    Any table of labelled findings will do; keep a share of its own out to measure with.
    Rows without a candidate or a label are left out.
    """
    order = F.xxhash64("candidate", "before", "path")
    rows = with_features(findings.where(F.col("label").isin(0, 1) & F.col("candidate").isNotNull()).orderBy(order, "candidate").limit(sample))
    rows = rows.select(*FEATURES, F.col("label").cast("double").alias("label")).coalesce(1)
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(rows)


def scan_secrets(df: DataFrame, model: PipelineModel, text: str = "text", row_id: str = "doc_id", path: str | None = None, least: float = 0.5) -> DataFrame:
    """Candidates of ``df`` with the forest's score: doc_id, place, candidate, before, path, score, is_secret.

    Those below ``least`` stay in the result with is_secret false. Null texts and ids,
    repeated rows and very long texts are as ``find_candidates`` has them; a null path is
    an empty one. An empty table gives an empty result. Columns other than text, id and
    path are not read.
    """
    scored = model.transform(with_features(find_candidates(df, text, row_id, path)))
    score = vector_to_array("probability")[1]
    return scored.select("doc_id", "place", "candidate", "before", "path", score.alias("score"), (score >= least).alias("is_secret"))
