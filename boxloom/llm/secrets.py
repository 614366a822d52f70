"""Secret scan with a random forest for false-positive removal. DataFrame and SQL functions only.

A candidate is a private-key block; a token of two or three dotted parts as web tokens have; any value of four or more characters
assigned to a name that announces a secret (quoted ones whole, passphrases to the end of the line, else up to white space, a quote, comma
or semicolon; the name may go on for 40 characters, and up to 8 spaces lie on either side of the sign); or a run of 12 or more characters
``[A-Za-z0-9+/_-]`` that holds a digit. Its features: length, shares of character classes, counts of class transitions along the string, entropy, the share of its letters
covered by a dictionary of the corpus' own frequent words (``dictionary_words``, at most ``MOST_WORDS``), a hash and flags of the path,
and hashes and flags of the neighbouring words, as far as they lie within ``CONTEXT`` characters. A random forest
trained on labelled findings gives the probability that a candidate is a secret.

Labelled findings come from people, or else from :func:`plant`: into passages of at most ``PLANT_DOCS`` of the given documents, drawn by
hash, generated secrets and look-alikes are set, announced by a name or not. A finding's label is what was planted; no rule and no
feature takes part in it. The forest is fitted on at most ``TRAIN_ROWS`` findings of each label, in the order of a hash; it is then
applied to all candidates.

Defined results: null and empty texts hold nothing; equal candidates in one text, and repeated rows, give findings of
their own; a null path counts as empty; without findings of both labels probability and is_secret are null;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxloom.llm.common import write_table

#: The candidate pattern, names that announce a secret, key prefixes of providers, test-like paths.
_NAME = r"(?i:token|pass(?:word|wd|phrase|code)?|pwd|secret|(?:api|access|private)[_-]?key|credential|auth)"
_REST, _SIGN = r"(?i:[a-z0-9_.\-]{0,40})", r"[\"']?\s{0,8}(?:=>|:=|[:=])\s{0,8}"
ANNOUNCE = _NAME
#: In this order: a key block, a web token, a quoted value of an announcing name up to its closing quote, a passphrase up to the end of its line,
#: another value of an announcing name, a long run with a digit.
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+-----END [A-Z ]{0,20}PRIVATE KEY-----"
    r"|(?=eyJ)(?<![A-Za-z0-9+/_\-])eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}(?:\.[A-Za-z0-9_\-]+)?"
    rf"|(?<=[\"'])(?<=[:=>]\s{{0,8}}[\"'])(?<={_NAME}{_REST}{_SIGN}[\"'])[^\"'\n]{{4,}}(?=[\"'])"
    rf"|(?<=[:=>\s])(?<=[:=>]\s{{0,8}})(?<=(?i:passphrase){_REST}{_SIGN})(?![=:>\s\"'])[^\"'\n]{{3,}}[^\s\"',;.)]"
    rf"|(?<=[:=>\s\"'])(?<=[:=>]\s{{0,8}}[\"']?)(?<={_NAME}{_REST}{_SIGN}[\"']?)(?![=:>\s\"'])[^\s\"',;]{{3,}}[^\s\"',;.)]"
    r"|(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{12,}={0,2}"
)
PREFIXES = r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|xox[abprs]-|sk_live_|rk_live_|AIza|glpat-|npm_|SG\.|eyJ|-----BEGIN)"
TEST_PATH = r"(?i)(test|example|sample|mock|fixture|doc)"
NAMES = ["token", "password", "secret", "api_key", "access_key", "auth_token", "credential", "pwd"]
LEADS = ["", "ref ", "id ", "order ", "commit ", "sha256 ", "see ", "number "]
PLACEHOLDERS = ["changeme", "xxxxxxxxxxxx", "********", "<YOUR_TOKEN>", "example", "${TOKEN}", "none", "required", "00000000000000000000"]

DICTIONARY_WORDS, MOST_WORDS = 400, 2_000
CONTEXT = 80
TRAIN_ROWS = 4_000
PLANT_DOCS = 400
TREES, DEPTH = 20, 6
BUCKETS = 64
SEED = 7


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """doc_id, path, ordinal, start (characters), value, before, after: one row per candidate."""
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col in docs.columns else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), path.alias("path"), F.col(text_col).cast("string").alias("t"))
    rows = rows.where(F.col("t").rlike(CANDIDATE))
    rows = rows.select("doc_id", "path", F.regexp_extract_all("t", F.lit(CANDIDATE), F.lit(0)).alias("v"), F.split("t", CANDIDATE, -1).alias("gap"))
    # what lies between two candidates is seen from both sides; only its ends travel on
    gaps = F.transform("gap", lambda g: F.struct(F.length(g).alias("n"), F.substring(g, -CONTEXT, CONTEXT).alias("tail"), F.substring(g, 1, CONTEXT).alias("head")))
    rows = rows.select("doc_id", "path", "v", gaps.alias("gap")).select("doc_id", "path", "gap", "v", F.posexplode("v").alias("ordinal", "value"))
    before = F.element_at("gap", F.col("ordinal") + 1)
    gone = lambda n: F.slice("gap", 1, F.col("ordinal") + 1) if n == "gap" else F.slice("v", 1, F.col("ordinal"))
    start = F.aggregate(gone("gap"), F.lit(0), lambda a, g: a + g["n"]) + F.aggregate(gone("v"), F.lit(0), lambda a, x: a + F.length(x))
    return rows.select("doc_id", "path", F.col("ordinal").cast("long").alias("ordinal"), start.cast("long").alias("start"), "value", before["tail"].alias("before"), F.element_at("gap", F.col("ordinal") + 2)["head"].alias("after"))


def dictionary(docs: DataFrame, text_col: str = "text", n: int = DICTIONARY_WORDS) -> list[str]:
    """The ``n`` most frequent words of 3 or more letters over all texts: bounded, as it becomes a pattern."""
    if n > MOST_WORDS:
        raise ValueError(f"a dictionary of {n} words: at most {MOST_WORDS} become a pattern")
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col).cast("string")), r"[^\p{L}]+")).alias("w")).where(F.length("w").between(3, 20))
    top = words.groupBy("w").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "w").limit(n)
    return [r["w"] for r in top.collect()]


def _count(c: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(pattern), F.lit(0))).cast("double")


def _bucket(c: Column) -> Column:
    return F.pmod(F.xxhash64(F.lower(c)), F.lit(BUCKETS)).cast("double")


CLASSES = {"lower": "[a-z]", "upper": "[A-Z]", "digit": "[0-9]", "sign": "[^A-Za-z0-9]"}


def features(found: DataFrame, words: list[str]) -> DataFrame:
    """``found`` with one column f_* per feature."""
    v, n = F.col("value"), F.greatest(F.length("value"), F.lit(1)).cast("double")
    out = {"f_length": F.length(v).cast("double")}
    for name, p in CLASSES.items():
        out[f"f_share_{name}"] = _count(v, p) / n
    for a, p in CLASSES.items():
        for b, q in CLASSES.items():
            out[f"f_step_{a}_{b}"] = _count(v, f"{p}(?={q})") / n
    chars = F.split(v, "")
    out["f_entropy"] = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - (F.size(F.filter(chars, lambda x: x == c)) / n) * F.log2(F.size(F.filter(chars, lambda x: x == c)) / n))
    letters = F.regexp_replace(F.lower(v), r"[^\p{L}]", "")
    known = "|".join(sorted(words, key=lambda w: (-len(w), w))) if words else "(?!)"
    out["f_dictionary"] = F.lit(1.0) - F.length(F.regexp_replace(letters, known, "")) / F.greatest(F.length(letters), F.lit(1)).cast("double")
    path = F.col("path")
    out |= {"f_path": _bucket(path), "f_path_test": path.rlike(TEST_PATH).cast("double"), "f_path_length": F.length(path).cast("double")}
    last = F.regexp_extract("before", r"(\S+)\s*$", 1)
    left = F.regexp_extract("before", r"(\S+)\s+\S+\s*$", 1)
    right = F.regexp_extract("after", r"^\S*\s+(\S+)", 1)
    near = F.regexp_extract("before", r"(\S*\s*\S*\s*\S*)$", 1)
    out |= {
        "f_prev": _bucket(last), "f_prev2": _bucket(left), "f_next": _bucket(right), "f_announced": near.rlike(ANNOUNCE).cast("double"),
        "f_assigned": F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double"), "f_quoted": F.col("before").rlike(r"[\"']$").cast("double"),
        "f_prefix": v.rlike(PREFIXES).cast("double"),
    }
    return found.select("*", *[F.coalesce(c, F.lit(0.0)).alias(k) for k, c in out.items()])


def plant(docs: DataFrame, text_col: str = "text", path_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """doc_id, source, text, value, label: passages of the documents with one planted finding each; 1 is a secret.

    Everything comes from hashes of the document's id and the kind, so a retry plants the same.
    """
    path = F.col(path_col).cast("string") if path_col in docs.columns else F.lit("")
    base = docs.select(F.xxhash64(id_col, text_col).alias("k"), path.alias("source"), F.col(text_col).cast("string").alias("t")).where(F.length("t") > 0)
    words = F.filter(F.split("t", r"[^\p{L}]+"), lambda w: F.length(w) > 2)
    # about four times as many as needed pass the hash, whatever the table's size; of those, passages only are sorted
    base = base.where(F.pmod(F.xxhash64("k"), F.lit(max(1, docs.count()))) < 4 * PLANT_DOCS)
    base = base.select("k", "source", F.slice(words, 1 + F.pmod("k", F.greatest(F.size(words) - 12, F.lit(1))), F.lit(12)).alias("w"))
    base = base.orderBy("k").limit(PLANT_DOCS)
    h = lambda *x: F.xxhash64("k", "kind", *[F.lit(i) for i in x])
    draw = lambda n, i: F.pmod(h(i), F.lit(n)).cast("int")
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), draw(len(xs), i) + 1)
    hexs = lambda i: F.sha2(F.concat_ws(":", "k", "kind", F.lit(i)).cast("binary"), 256)
    b64 = lambda i: F.translate(F.base64(F.unhex(hexs(i))), "+/=", "Xy")
    word = lambda i: F.coalesce(F.try_element_at("w", (F.pmod(h(i), F.greatest(F.size("w"), F.lit(1))) + 1).cast("int")), F.lit("word"))
    digits = lambda n, i: F.substring(F.conv(F.substring(hexs(i), 1, 15), 16, 10), 2, n)
    lines = F.concat_ws("\n", *[F.base64(F.unhex(hexs(i))) for i in range(50, 58)])
    secret = {  # kind: (value, set behind a name always (1), half of the time (2))
        "hex": (F.substring(hexs(1), 1, 40), 2), "hex_upper": (F.upper(F.substring(hexs(1), 1, 40)), 2), "hex_short": (F.substring(hexs(1), 1, 32), 2),
        "base64": (F.substring(F.base64(F.unhex(hexs(1))), 1, 40), 2), "aws": (F.concat(F.lit("AKIA"), F.upper(F.substring(b64(1), 1, 16))), 2),
        "hub": (F.concat(F.lit("ghp_"), F.substring(b64(1), 1, 36)), 2), "pay": (F.concat(F.lit("sk_live_"), F.substring(b64(1), 1, 24)), 2),
        "web": (F.concat(F.lit("eyJ"), b64(1), F.lit(".eyJ"), b64(2), F.lit("."), b64(3)), 2), "marked": (F.concat(F.initcap(word(1)), pick("@!#$%", 2), digits(4, 3), pick("!?*", 4)), 1),
        "plain": (F.concat(F.lower(word(1)), digits(2, 2)), 1), "letters": (F.translate(F.substring(b64(1), 1, 24), "0123456789", "qwertzuiop"), 1),
        "block": (F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), lines, F.lit("\n-----END RSA PRIVATE KEY-----")), 0),
    }
    false = {
        "card": (digits(16, 1), 3), "number": (digits(12, 1), 3), "uuid": (F.concat_ws("-", *[F.substring(hexs(1), a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), 0),
        "stamp": (F.concat(F.lit("202"), digits(5, 1), F.lit("T"), digits(6, 2)), 0), "name": (F.concat(F.lower(word(1)), F.lit("_"), F.lower(word(2)), F.lit("_"), F.lower(word(3)), digits(1, 4)), 3),
        "path": (F.concat(F.lit("/"), F.lower(word(1)), F.lit("/"), F.lower(word(2)), F.lit("-"), digits(3, 3)), 3), "build": (F.concat(F.lit("release-202"), digits(1, 1), F.lit("-build-"), digits(4, 2)), 0),
        "camel": (F.concat(F.lower(word(1)), F.initcap(word(2)), F.initcap(word(3)), digits(2, 4)), 0), "holder": (pick(PLACEHOLDERS, 1), 1), "word": (F.lower(word(1)), 1),
        "words": (F.concat(F.lower(word(1)), F.lit("-"), F.lower(word(2))), 1), "run": (F.concat(F.repeat(F.substring(hexs(1), 1, 1), 8), F.repeat(digits(1, 2), 8)), 0),
    }
    kinds = [(k, v, how, y) for y, group in ((1, secret), (0, false)) for k, (v, how) in group.items()]
    rows = base.withColumn("kind", F.explode(F.array(*[F.lit(k) for k, *_ in kinds])))
    choose = lambda f: F.coalesce(*[F.when(F.col("kind") == k, f(v, how, y)) for k, v, how, y in kinds])
    rows = rows.withColumn("value", choose(lambda v, how, y: v)).withColumn("label", choose(lambda v, how, y: F.lit(y)))
    named = choose(lambda v, how, y: {0: F.lit(False), 1: F.lit(True), 2: draw(2, 20) == 0, 3: draw(8, 20) == 0}[how])
    quote = pick(['"', "'", ""], 21)
    name = F.when(draw(4, 22) == 0, F.upper(pick(NAMES, 23))).otherwise(pick(NAMES, 23))
    put = F.when(named, F.concat(name, pick([" = ", ": ", "=", " := "], 24), quote, "value", quote)).otherwise(F.concat(pick(LEADS, 25), "value"))
    text = F.concat_ws(" ", F.array_join(F.slice("w", 1, 6), " "), put, F.array_join(F.slice("w", 7, 6), " "))
    return rows.select(F.xxhash64("k", "kind").alias("doc_id"), "source", text.alias("text"), "value", "label")


def fit(labelled: DataFrame):
    """The forest on at most ``TRAIN_ROWS`` findings of each label (column ``label``); None without both labels."""
    cols = [c for c in labelled.columns if c.startswith("f_")]
    parts = [labelled.where(F.col("label") == y).orderBy(F.xxhash64("value", "doc_id", "ordinal"), "doc_id", "ordinal").limit(TRAIN_ROWS) for y in (0, 1)]
    train = write_table(parts[0].unionByName(parts[1]).select(*cols, F.col("label").cast("double").alias("label")).coalesce(1), "train")
    if len(train.select("label").distinct().collect()) < 2:
        return None
    ready = VectorAssembler(inputCols=cols, outputCol="f_all").transform(train)
    return RandomForestClassifier(featuresCol="f_all", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(ready)


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("value", T.StringType()), T.StructField("label", T.IntegerType())])


def scan(docs: DataFrame, labelled: DataFrame | None = None, path_col: str = "source", threshold: float = 0.5, dictionary_words: int = DICTIONARY_WORDS) -> DataFrame:
    """All candidates with probability and is_secret.

    ``labelled``: findings (doc_id, value, label) checked by people; without them findings are planted.
    """
    words = dictionary(docs, n=dictionary_words)
    found = write_table(features(candidates(docs, path_col=path_col), words), "findings")
    if labelled is None:
        planted = write_table(plant(docs, path_col=path_col), "planted")
        train = features(candidates(planted), words).join(planted.select("doc_id", "value", "label"), ["doc_id", "value"])
    else:
        marks = labelled.select("doc_id", "value", "label").groupBy("doc_id", "value").agg(F.max("label").alias("label"))
        train = found.join(marks, ["doc_id", "value"])
    model = fit(train.where("label IS NOT NULL"))
    if model is None:
        scored = found.withColumn("probability", F.lit(None).cast("double"))
    else:
        cols = [c for c in found.columns if c.startswith("f_")]
        ready = VectorAssembler(inputCols=cols, outputCol="f_all").transform(found)
        scored = model.transform(ready).withColumn("probability", vector_to_array("probability")[1])
    kind = (
        F.when(F.col("value").startswith("-----BEGIN"), "private key").when(F.col("value").rlike(PREFIXES), "provider key")
        .when(F.col("value").rlike("^[0-9]+$"), "digits").when(F.col("value").rlike("^[0-9a-f]+$"), "hex").otherwise("mixed")
    )
    return scored.select(
        "doc_id", "path", "ordinal", "start", F.length("value").cast("long").alias("n_chars"), F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"),
        kind.alias("kind"), F.round("probability", 6).alias("probability"), (F.col("probability") >= threshold).alias("is_secret"),
    )
