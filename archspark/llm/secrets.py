"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a run of LEAST or more characters of keys and encoded bytes. Its features:
length, shares of digits, capitals and vowels, transitions between character classes,
distinct characters, coverage by dictionary words, whether it or what stands before it
looks like a path, whether the document's own path speaks of tests or samples, and words
beside it that speak of secrets or of checksums. The forest is fitted on labelled findings
(`labelled`, LABELLED rows at most; a table of one's own of the same columns may be given)
and applied to all candidates of all texts, in the JVM throughout.

Null and empty texts have no candidates. Repeated rows give repeated findings. A null path
says nothing. Positions count characters from 0. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LEAST, CONTEXT = 16, 40
CANDIDATE = rf"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{{{LEAST},}}+={{0,2}}"
#: Rows the forest is fitted on, at most, and its shape.
LABELLED, TREES, DEPTH, SEED, THRESHOLD = 4000, 24, 7, 7, 0.5

# Parts of ordinary words and identifiers, words near secrets and near other codes.
DICTIONARY = "test example sample demo dummy value name user path file http https www com org html index data config default class function string number object error message content page image license version the and tion ing ent ment ness able ight ough ement ance ence our that this with from have not are was for you all will one can has her his its out who get set new http log main list item type time date"
SECRET_WORDS = "token secret passwd password pwd apikey api_key api-key key auth bearer credential private access"
OTHER_WORDS = "sha1 sha256 sha md5 checksum digest commit hash uuid guid etag integrity revision"
SAMPLE_PATH = "test|example|sample|fixture|mock|docs?"

FEATURES = ("length", "digits", "capitals", "vowels", "transitions", "distinct", "coverage", "pathlike", "sample_path", "near_secret", "near_other")


def _any_of(words: str) -> str:
    return "(?i)(?<![a-z0-9])(" + "|".join(sorted(words.split(), key=lambda w: (-len(w), w))) + ")(?![a-z0-9])"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text, source -> doc_id, path, start, candidate, before, after."""
    rows = docs.select("doc_id", F.col("source").alias("path"), "text").filter(F.col("text").rlike(CANDIDATE))
    rows = rows.select("doc_id", "path", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split("text", CANDIDATE).alias("gaps"))
    # What stands between candidates, and the length of everything up to each of them.
    rows = rows.withColumn("starts", F.expr("aggregate(sequence(0, size(found) - 1), named_struct('at', 0, 'all', cast(array() as array<int>)), (a, i) -> named_struct('at', a.at + length(gaps[i]) + length(found[i]), 'all', concat(a.all, array(a.at + length(gaps[i])))), a -> a.all)"))
    rows = rows.select("doc_id", "path", "gaps", "starts", F.posexplode("found").alias("i", "candidate"))
    return rows.select("doc_id", "path", F.expr("starts[i]").alias("start"), "candidate", F.expr(f"right(gaps[i], {CONTEXT})").alias("before"), F.expr(f"left(gaps[i + 1], {CONTEXT})").alias("after"))


def features(rows: DataFrame) -> DataFrame:
    """candidate, before, after, path -> the same and FEATURES."""
    c = F.col("candidate")
    n = F.length(c).cast("double")
    count = lambda pattern: F.regexp_count(c, F.lit(pattern))
    either: Column = F.concat_ws(" ", F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")))
    words = "|".join(sorted(set(DICTIONARY.split()), key=lambda w: (-len(w), w)))
    return rows.withColumns({
        "length": F.least(n, F.lit(200.0)),
        "digits": count("[0-9]") / n,
        "capitals": count("[A-Z]") / n,
        "vowels": count("(?i)[aeiou]") / n,
        "transitions": (count("[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+") - 1) / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "coverage": 1 - F.length(F.regexp_replace(c, f"(?i)(?:{words})", "")) / n,
        "pathlike": (F.coalesce(F.col("before"), F.lit("")).rlike(r"[/\\]$|://\S*$") | (count("/") > 1)).cast("double"),
        "sample_path": F.coalesce(F.col("path").rlike(f"(?i)(^|[/_.-])({SAMPLE_PATH})"), F.lit(False)).cast("double"),
        "near_secret": either.rlike(_any_of(SECRET_WORDS)).cast("double"),
        "near_other": either.rlike(_any_of(OTHER_WORDS)).cast("double"),
    })


def labelled(spark: SparkSession, n: int = LABELLED, salt: str = "fit") -> DataFrame:
    """n made-up findings: candidate, before, after, path, label (1: a secret)."""
    sha = lambda k: f"sha2(concat('{salt}/{k}/', id), 256)"
    pick = lambda k, *of: f"element_at(array({', '.join(repr(x) for x in of)}), cast(pmod(xxhash64('{salt}{k}', id), {len(of)}) as int) + 1)"
    length = lambda k, lo, hi: f"cast({lo} + pmod(xxhash64('{salt}{k}', id), {hi - lo + 1}) as int)"
    mixed = f"translate(base64(unhex({sha('b')})), '=', '')"
    syllable = lambda k: pick(k, "th", "er", "on", "an", "in", "ed", "nd", "ha", "re", "tion", "es", "st", "le", "ou", "eau", "ver", "ung", "sch", "ment", "que", "ciu", "dad", "ent", "ing")
    word = "concat(" + ", ".join(syllable(f"s{i}") for i in range(9)) + ")"
    kinds = [  # candidate, before, after, label
        (f"substr({sha('h')}, 1, {length('hl', 32, 64)})", pick("hb", 'token = "', "api_key: ", "secret=", 'password="', "Authorization: Bearer "), pick("ha", '" then', "\n", ";", " and"), 1),
        (f"substr({mixed}, 1, {length('bl', 20, 43)})", pick("bb", 'key = "', "access token: ", "SECRET: ", "passwd=", "credential "), pick("ba", '"', "\n", " with", ""), 1),
        (f"concat({pick('p', 'AKIA', 'ghp_', 'sk_live_', 'xoxb-')}, substr({mixed}, 1, {length('pl', 16, 36)}))", pick("pb", "export ID=", "use ", 'key "', "", "login with "), pick("pa", '"', " now", "\n"), 1),
        (f"upper(substr({sha('u')}, 1, 40))", pick("ub", 'TOKEN = "', "SECRET ", 'API_KEY="'), pick("ua", '"!!', " ", "\n"), 1),
        (f"substr({word}, 1, {length('wl', 17, 30)})", pick("wb", "the ", "of ", "and, ", "key ", ". ", "token "), pick("wa", " of", ", the", ".", " in"), 0),
        (f"initcap(substr({word}, 1, {length('cl', 17, 28)}))", pick("cb", ". ", "\n", "the "), pick("ca", " and", ",", "."), 0),
        (f"upper(substr({word}, 1, {length('vl', 17, 28)}))", pick("vb", "!! ", "THE ", ""), pick("va", "!!", " OF"), 0),
        (f"translate(substr({sha('d')}, 1, 16), 'abcdef', '907315')", pick("db", "card ", "call ", "", "no. ", "the "), pick("da", " ", ",", "."), 0),
        (f"substr({sha('g')}, 1, {length('gl', 32, 64)})", pick("gb", "sha256: ", "commit ", "checksum=", "md5 ", 'integrity "'), pick("ga", " ", "\n", "."), 0),
        (f"concat(substr({sha('i')}, 1, 8), '-', substr({sha('i')}, 9, 4), '-', substr({sha('i')}, 13, 4), '-', substr({sha('i')}, 17, 12))", pick("ib", "uuid ", "guid=", "id ", "etag: "), pick("ia", " ", "\n"), 0),
        (f"concat({syllable('x')}, '/', {syllable('y')}, '/', {word}, '/index')", pick("xb", "https://example.com/", "see ", "/", "in "), pick("xa", ".html", " ", ".py"), 0),
        (f"concat({pick('e', 'example', 'sample', 'dummy', 'test')}, '_', {pick('f', 'token', 'secret', 'value', 'key')}, '_', {word})", pick("eb", 'token = "', "key: ", "secret="), pick("ea", '"', " "), 0),
        ("repeat('x', 24)", pick("rb", "password: ", "key ", ""), "''", 0),
        (f"repeat({pick('q', '-', '_', '=', '0')}, {length('ql', 16, 60)})", "'\\n'", "'\\n'", 0),
    ]
    case = lambda j: "case " + " ".join(f"when pmod(id, {len(kinds)}) = {i} then {k[j]}" for i, k in enumerate(kinds)) + " end"
    path = pick("path", "src0", "src12", "web/notes", "app/main", "tests/unit", "crawl")
    rows = spark.range(0, min(n, LABELLED), 1, 1)
    return rows.select(*[F.expr(case(j)).alias(name) for j, name in enumerate(("candidate", "before", "after", "label"))], F.expr(path).alias("path")).withColumn("label", F.col("label").cast("double"))


def fit(rows: DataFrame) -> PipelineModel:
    """A forest over FEATURES from labelled findings; it depends on the rows and the seed alone."""
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    model: RandomForestClassificationModel = forest.fit(assembler.transform(features(rows)).select("features", "label"))
    return PipelineModel([assembler, model])


def scan(docs: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text, source -> doc_id, path, start, candidate, before, after, score: the findings at or above the threshold."""
    model = fit(labelled(docs.sparkSession) if labels is None else labels.orderBy(F.xxhash64("candidate", "before", "after", "path", "label")).limit(LABELLED))
    scored = model.transform(features(candidates(docs))).withColumn("score", F.round(vector_to_array("probability")[1], 4))
    return scored.filter(F.col("score") >= threshold).select("doc_id", "path", "start", "candidate", "before", "after", "score")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("secret_sha256"), "score")
