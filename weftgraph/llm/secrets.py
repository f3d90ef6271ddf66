"""Secret scan: candidates by pattern, false positives removed by a random forest.

Everything is DataFrame and SQL functions.  A candidate is a value that an assigning word leads to (`password = "..."`,
six characters or more, of any kind), or a run of 16 or more key characters wherever it stands.  Lines with a candidate
are found by one regular expression; each candidate gets features of itself (length, transitions between character
classes, variety, digits, letter pairs, dictionary coverage), of its path and of the words before and behind it.  The
forest is Spark's own and is trained on labelled findings: a table (candidate, before, after, path, label) of any size,
by default the one that labelled_findings() writes out by rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words whose presence near a candidate, in it, or in its path says something.
ASSIGNING = "token|secret|key|passw|pwd|passphrase|auth|bearer|credential|api|access|private|jeton|clave|schl"
HARMLESS = "commit|sha1|sha256|md5|checksum|digest|uuid|guid|revision|version|hash|etag|integrity|example|dummy|fake|placeholder|sample"
DICTIONARY = "the|and|for|you|your|here|test|example|sample|dummy|changeme|secret|password|token|key|api|user|name|admin|main|java|src|com|org|index|module|import|class|version|config|data|file|path|http|www|html|none|null|true|false|required|optional|string|value|default|abcdef|12345|xxxx|0000"
QUIET_PATH = "test|spec|example|sample|docs|fixture|mock|vendor|node_modules|lock$"
PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce|li|ch|ll|be|ma|si|om|ur|ue|qu|ei|un|ge|do|la|lo|ta|us|ie|ns"
KEY_PART = 64  # characters of a key behind its assigning word; at a longer one only a later assigning word of it leads on
RUN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}"
#: Groups: the assigning words, a quoted value, a bare value, a run.
CANDIDATE = f"((?i:{ASSIGNING})[A-Za-z0-9_.\\[\\]-]{{0,{KEY_PART}}}+[\"'`]?\\s{{0,3}}(?:[:=]=?>?|\\sis\\s)\\s{{0,3}}(?:(?i:bearer|basic)\\s)?)(?:[\"'`]([^\"'`]{{6,}})(?=[\"'`])|([^\\s\"'`,;<>]{{6,}}))|({RUN})"
FEATURES = ("length", "transitions", "variety", "digits", "symbols", "hexadecimal", "vowels", "pairs", "coverage", "assigned", "operator", "quoted", "harmless", "harmless_after", "quiet_path")
TREES, DEPTH, THRESHOLD = 32, 9, 0.5


def features(found: DataFrame) -> DataFrame:
    """found (candidate, before, after, path, ...) with the columns of FEATURES; null texts count as empty."""
    c, before, after, path = (F.coalesce(F.col(x), F.lit("")) for x in ("candidate", "before", "after", "path"))
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    low = F.lower(c)
    letters = F.length(F.regexp_replace(low, "[^a-z]", ""))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]+", "\u0001"), "[A-Z]+", "\u0002"), "[0-9]+", "\u0003"), "[^\u0001\u0002\u0003]+", "\u0004")
    return found.select(
        "*",
        n.alias("length"),
        (F.length(shape) / n).alias("transitions"),
        (F.size(F.array_distinct(F.split(c, ""))) / n).alias("variety"),
        (F.length(F.regexp_replace(c, "[^0-9]", "")) / n).alias("digits"),
        (F.length(F.regexp_replace(c, "[A-Za-z0-9]", "")) / n).alias("symbols"),
        c.rlike("^[0-9a-fA-F]+$").cast("double").alias("hexadecimal"),
        (F.length(F.regexp_replace(low, "[^aeiou]", "")) / F.greatest(letters, F.lit(1))).alias("vowels"),
        ((n - F.length(F.regexp_replace(low, PAIRS, ""))) / n).alias("pairs"),
        ((n - F.length(F.regexp_replace(low, DICTIONARY, ""))) / n).alias("coverage"),
        F.lower(before).rlike(ASSIGNING).cast("double").alias("assigned"),
        before.rlike("[=:]>?\\s*(?i:bearer\\s|basic\\s)?[\"'`]?$").cast("double").alias("operator"),
        before.rlike("[\"'`]$").cast("double").alias("quoted"),
        F.lower(before).rlike(HARMLESS).cast("double").alias("harmless"),
        F.lower(after).rlike(HARMLESS).cast("double").alias("harmless_after"),
        F.lower(path).rlike(QUIET_PATH).cast("double").alias("quiet_path"),
    )


def labelled_findings(spark: SparkSession, n: int = 2400, salt: str = "") -> DataFrame:
    """(candidate, before, after, path, label): findings of known kind, a row for each number below n, written out by rule.

    Another salt gives other keys, words and numbers of the same kinds.
    """
    row = F.col("id").cast("string")
    text = lambda kind: F.concat(F.lit(f"{salt}{kind}"), row)
    hexes, md5 = F.sha1(text("a")), F.md5(text("c"))
    mixed = F.translate(F.base64(F.unhex(F.sha2(text("b"), 256))), "=", "")
    letters = F.substring(F.regexp_replace(F.base64(F.unhex(F.sha2(text("d"), 512))), "[0-9+/=]", ""), 1, 32)

    def pick(*values: str, by: str = "p") -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(text(by)), F.lit(len(values))) + 1).cast("int"))

    syllables = F.create_map(*(F.lit(x) for pair in zip("0123456789abcdef", ("ing", "tion", "the", "er", "ment", "ver", "heit", "con", "ed", "an", "re", "st", "lich", "ung", "que", "mente"), strict=True) for x in pair))

    def word(k: int, by: str) -> Column:
        """A long word of common syllables."""
        return F.array_join(F.transform(F.split(F.substring(F.md5(text(by)), 1, k), ""), lambda c: F.coalesce(F.element_at(syllables, c), F.lit(""))), "")

    lead = pick('token = "', 'secret: "', "api_key=", 'password = "', "Authorization: Bearer ", 'access_key = "', "SECRET_KEY='", "client_secret: ", "auth_token=")
    login = pick('password = "', "passwd=", "pwd: '", 'db_password: "', "PASSWORD=", 'pass_key = "', "passphrase: '")
    plain = pick("of the ", "und die ", "que la ", "see ", "et le ", "in ", "", "was, ")
    path = pick("src/app", "conf/prod", "deploy", "settings", "src7", "src12", "notes", "", "infra/main")
    rest = pick('"', "'", "", '" in', ";", " and the", by="r")
    short = F.substring(mixed, 1, 12)
    kinds = [
        (hexes, lead, rest, path, 1),
        (F.upper(hexes), F.upper(lead), rest, path, 1),
        (mixed, lead, rest, path, 1),
        (F.substring(mixed, 1, 24), lead, rest, path, 1),
        (md5, lead, rest, path, 1),
        (letters, lead, rest, path, 1),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(md5, 1, 16))), plain, rest, path, 1),
        (F.concat(F.lit("ghp_"), F.substring(mixed, 1, 36)), plain, rest, path, 1),
        (F.concat(pick("hunter", "dragon", "Sommer", "letmein", "qwert", "Monkey"), F.substring(F.translate(md5, "abcdef", ""), 1, 3), pick("!", "", "#", "?", "*", by="s")), login, rest, path, 1),
        (short, login, rest, path, 1),
        (F.concat(word(3, "w"), pick("-", "", ".", by="t"), word(3, "v"), F.substring(F.translate(md5, "abcdef", ""), 1, 2)), login, rest, path, 1),
        (F.concat_ws(" ", word(2, "w"), word(2, "v"), word(2, "u"), word(2, "x")), pick('passphrase = "', "password: '"), F.lit('"'), path, 1),
        (hexes, pick("commit ", "sha1: ", "revision = ", "checksum: "), rest, path, 0),
        (md5, pick("md5 = ", "etag: ", "hash: ", "digest "), rest, path, 0),
        (hexes, plain, pick(" is the commit", " (sha1)", " checksum", " of this revision"), path, 0),
        (F.sha2(text("e"), 256), pick('"sha256": "', "integrity = ", "checksum: "), rest, F.lit("package-lock"), 0),
        (F.concat_ws("-", F.substring(md5, 1, 8), F.substring(md5, 9, 4), F.substring(md5, 13, 4), F.substring(md5, 17, 4), F.substring(md5, 21, 12)), pick("uuid: ", "guid = ", "id "), rest, path, 0),
        (F.concat(F.lit("your_api_key_here_"), row), lead, rest, path, 0),
        (F.concat(F.lit("example-token-xxxx-0000-"), row), lead, rest, pick("tests/fixture", "docs/example"), 0),
        (F.concat(F.lit("src/main/java/com/module/version"), row), plain, rest, path, 0),
        (F.concat(F.lit("configuration_file_index_"), row), plain, rest, path, 0),
        (F.lpad(row, 20, "0"), plain, rest, path, 0),
        (F.substring(F.translate(md5, "abcdef", "123456"), 1, 16), plain, rest, path, 0),
        (F.concat(F.lit("changeme_password_"), row), lead, rest, path, 0),
        (F.repeat(pick("0x", "*", "x", "ab", "0"), 16), lead, rest, path, 0),
        (F.concat(F.lit("/docs/html/index"), row, F.lit("/the-main-page")), plain, rest, path, 0),
        (hexes, plain, rest, pick("docs/log", "vendor/list", "yarn-lock"), 0),
        (F.concat(F.lit("abcdefabcdef12345"), row), lead, rest, F.lit("tests"), 0),
        (F.concat(F.lit("importNameClassVersion"), row), plain, rest, path, 0),
        (word(7, "w"), plain, rest, path, 0),
        (F.initcap(word(6, "v")), plain, rest, path, 0),
        (word(3, "u"), pick("key: ", "author: ", "token: ", "access: ", "api is ", "secret = "), rest, path, 0),
        (F.concat(word(2, "x"), F.lit("_"), word(2, "y"), F.lit("()")), pick("token = ", "password=", "secret: ", "key = "), rest, path, 0),
        (pick("required", "optional", "string", "undefined", "<your-key>", "********", "process.env", "${SECRET}", "default value", by="q"), lead, rest, path, 0),
    ]
    columns = ("candidate", "before", "after", "path", "label")
    which, parts = F.pmod(F.col("id"), F.lit(len(kinds))), []
    for at in range(0, len(kinds), 8):  # eight kinds are as much as one generated method holds
        shown = [(F.lit(None).cast("double" if c == "label" else "string"), c) for c in columns]
        for i, values in enumerate(kinds[at : at + 8], at):
            shown = [(F.when(which == i, (v if isinstance(v, Column) else F.lit(v)).cast("double" if c == "label" else "string")).otherwise(out), c) for v, (out, c) in zip(values, shown, strict=True)]
        parts.append(spark.range(0, n, 1, 1).where((which >= at) & (which < at + 8)).select(*(out.alias(c) for out, c in shown)))
    return reduce(DataFrame.unionAll, parts)


def train(labelled: DataFrame, seed: int = 8) -> PipelineModel:
    """A random forest over FEATURES from rows (candidate, before, after, path, label 0 or 1)."""
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="_vector")
    forest = RandomForestClassifier(featuresCol="_vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=seed, predictionCol="_said", probabilityCol="_shares", rawPredictionCol="_raw")
    rows = assembler.transform(features(labelled.where(F.col("label").isNotNull())))
    return PipelineModel([assembler, forest.fit(rows)])


def _last_words(text: Column, n: int) -> Column:
    return F.regexp_extract(text, f"(?:\\S*\\s+){{0,{n}}}\\S*$", 0)


def _first_words(text: Column, n: int) -> Column:
    return F.regexp_extract(text, f"^\\S*(?:\\s+\\S+){{0,{n}}}", 0)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(id, line_no, nth, candidate, before, after, path): every candidate of a line in order, with up to three words on either side.

    Whole texts are searched; a line without a candidate is dropped before it is split.  before ends with the
    assigning words, the operator and the quote that lead to the candidate, if any do.
    """
    lines = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{path_col}`").cast("string").alias("path"), F.col(f"`{text_col}`").alias("text")).where(F.col("text").rlike(CANDIDATE))
    lines = lines.select("id", "path", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).where(F.col("line").rlike(CANDIDATE))
    lead, quoted, bare, run = (F.regexp_extract_all("line", F.lit(CANDIDATE), F.lit(k)).alias(name) for k, name in enumerate(("lead", "quoted", "bare", "run"), 1))
    rows = lines.select("id", "path", "line_no", lead, quoted, bare, run, F.split("line", CANDIDATE, -1).alias("between"))
    hits = F.transform("lead", lambda x, k: F.struct(k.alias("nth"), x.alias("lead"), F.get("quoted", k).alias("quoted"), F.get("bare", k).alias("bare"), F.get("run", k).alias("run"), F.get("between", k).alias("left"), F.get("between", k + 1).alias("right")))
    found = rows.select("id", "path", "line_no", F.explode(hits).alias("h")).select("id", "path", "line_no", "h.*")
    before = F.concat(_last_words("left", 3), "lead", F.when(F.col("quoted") != "", F.lit('"')).otherwise(""))
    return found.select(F.col("id").alias(id_col), "line_no", "nth", F.concat("quoted", "bare", "run").alias("candidate"), before.alias("before"), _first_words("right", 3).alias("after"), "path")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", labelled: DataFrame | None = None, model: PipelineModel | None = None) -> DataFrame:
    """(id, line_no, nth, candidate, before, after, path, score, is_secret): candidates, one row each, with the forest's verdict.

    score is the forest's share for a secret.  Null and empty texts have no candidate; a null path counts as ''; equal
    rows are reported as often as they occur; rows with a null id are scanned too; columns of docs beside the three
    are not read; an empty table gives an empty one.
    """
    if model is None:
        model = train(labelled if labelled is not None else labelled_findings(docs.sparkSession))
    judged = model.transform(features(candidates(docs, id_col, text_col, path_col).withColumnRenamed(id_col, "_id")))
    score = vector_to_array("_shares")[1]
    return judged.select(F.col("_id").alias(id_col), "line_no", "nth", "candidate", "before", "after", "path", score.alias("score"), (score >= THRESHOLD).alias("is_secret"))
