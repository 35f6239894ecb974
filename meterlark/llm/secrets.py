"""Secret scan: assigned values and long tokens as candidates, a random forest to remove false positives
(DataFrame and JVM-side ML operations only).

A candidate is the value alone, without the name it is assigned to: (1) a dotted token (``eyJ...``), whole;
(2) what stands behind a name with a telling word (password, token, key, ...) and ``=`` or ``:``, from
``SHORTEST_VALUE`` characters on and with any characters but blanks, brackets and quotes; (3) any run of at
least ``SHORTEST`` letters, digits and ``+/_-``, with its ``=`` padding. Its features are its length and
character classes, the transitions between classes and between vowels and consonants, the share
that dictionary words cover, what its path (the document's source, and any path it stands in) says,
and the words before and after it. The dictionary holds a list of common words and the words that are
most frequent in the texts themselves (counted over all of them, ``DICTIONARY_WORDS`` kept).

The forest is trained from a table of labelled findings (candidate, before, after, path, label): pass your
own to ``scan``. No table here has such findings, so ``labelled_findings`` makes ``FINDINGS`` rows by rule,
secrets of usual shapes where they usually stand, and identifiers, words, digests, numbers, paths and
placeholders that look alike, some of them where secrets stand. Training reads that table only, so it
costs the same at every input size.

Texts are cut in place: the pieces between candidates come with them, so no text is shuffled.

Defined results: null and empty texts have no findings; candidates never overlap (the leftmost match counts,
in the order above); a candidate of any length is one finding; repeated rows each report theirs; null source
counts as an empty path; equal candidates get equal scores where their surroundings are equal; an empty
table gives an empty table; extra columns of any name are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlark.llm.common import materialise

SHORTEST, SHORTEST_VALUE = 16, 6
#: A name with a telling word, and what assigns a value to it.
TELLING = r"(?i:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)"
ASSIGNS = rf"[A-Za-z0-9_.\-]{{0,40}}?{TELLING}[A-Za-z0-9_\-]{{0,20}}[\"']?\s{{0,3}}(?::=|=>|=|:)\s{{0,3}}(?:(?i:bearer|basic)\s)?[\"'`]?"
_END = r"\s\"'`,;<>()\[\]{}"
VALUE = rf"(?:(?<=[\"'`])[^\s\"'`]{{{SHORTEST_VALUE},}}(?=[\"'`])|[^{_END}]{{{SHORTEST_VALUE - 1},}}[^{_END}.:?])"
DOTTED = r"eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}(?:\.[A-Za-z0-9_\-]*)?"
CANDIDATE = rf"{DOTTED}|(?<![A-Za-z0-9_.\-]){ASSIGNS}{VALUE}|[A-Za-z0-9][A-Za-z0-9+/_\-]{{{SHORTEST - 1},}}={{0,2}}"
FINDINGS = 6_000
TREES, DEPTH, SEED = 30, 8, 11
BEFORE, AFTER = 64, 24
#: Most words of the texts that the dictionary takes, and how often they occur at least.
DICTIONARY_WORDS, DICTIONARY_LEAST = 4_000, 5

#: Words that long identifiers and ordinary text are made of.
DICTIONARY = (
    "about account action address after agent another array author background base block branch build cache change check "
    "class client close code collection color column commit config connection content context control count create current "
    "data date default delete description device document download element end error event example export factory field file "
    "filter find first format from function get group handle have header home host image import index information input "
    "install integration interface internal item java language last length level library license line link list load local "
    "location manager map message method model module name network next node number object option order output package page "
    "parameter parse path people place point position process product project property provider query read record reference "
    "register release report request resource response result return right root sample schema script search section select "
    "server service session set simple size software source start state status string system table template test text that "
    "the there thing time title tree type unit update user value version view which width window with work world write"
).split()

FEATURES = (
    "length digits uppers symbols punctuation distinct vowels hexadecimal transitions alternations consonant_runs longest_repeat "
    "coverage only_letters dots slashes in_path path_says_test keyword named assigned quoted digest_word digest_like example_word prefix_known"
).split()


def dictionary_of(docs: DataFrame, most: int = DICTIONARY_WORDS) -> list[str]:
    """The most frequent words of all texts, three to fourteen letters long; ``most`` of them reach the driver."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+")).alias("w"))
    words = words.filter(F.length("w").between(3, 14)).groupBy("w").agg(F.count("*").alias("n"))
    top = words.filter(F.col("n") >= DICTIONARY_LEAST).orderBy(F.desc("n"), "w").limit(most)
    return [r["w"] for r in top.collect()]


def features(candidate: Column, before: Column, after: Column, path: Column, words: list[str] | None = None) -> list[Column]:
    """The columns named in ``FEATURES``, as doubles; ``words`` are the dictionary's beside ``DICTIONARY``."""
    low = F.lower(candidate)
    size = F.length(candidate).cast("double")
    count = lambda pattern, of=candidate: F.regexp_count(of, F.lit(pattern)).cast("double")
    flag = lambda condition: F.coalesce(condition, F.lit(False)).cast("double")
    known = sorted({*DICTIONARY, *(words or ())})
    parts = F.regexp_extract_all(candidate, F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}"), 0)
    covered = F.aggregate(F.filter(F.transform(parts, F.lower), lambda w: w.isin(known)), F.lit(0), lambda n, w: n + F.length(w))
    found = {
        "length": F.least(size, F.lit(200.0)),
        "digits": count("[0-9]") / size,
        "uppers": count("[A-Z]") / size,
        "symbols": count("[^A-Za-z0-9]") / size,
        "punctuation": count(r"[^A-Za-z0-9+/=_.\-]"),
        "distinct": F.size(F.array_distinct(F.split(candidate, ""))) / size,
        "vowels": count("[aeiou]", low) / F.greatest(F.lit(1.0), count("[a-z]", low)),
        "hexadecimal": flag(candidate.rlike("^[0-9a-fA-F]+$")),
        "transitions": count("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])") / size,
        "alternations": count("(?<=[aeiou])(?=[b-df-hj-np-tv-z])|(?<=[b-df-hj-np-tv-z])(?=[aeiou])", low) / size,
        "consonant_runs": count("[b-df-hj-np-tv-xz]{4}", low) / size,
        "longest_repeat": count(r"(.)\1\1", low) / size,
        "coverage": covered / size,
        "only_letters": flag(candidate.rlike(r"^[A-Za-z_.\-/]+$")),
        "dots": count(r"\."),
        "slashes": count("/"),
        "in_path": flag(F.concat(before, candidate).rlike(r"(?:[a-z]+://|\.{0,2}/|[A-Za-z]:\\)\S*$") & F.concat(candidate, after).rlike(r"^\S*[/.]")),
        "path_says_test": flag(F.lower(path).rlike("test|example|sample|mock|fixture|doc")),
        "keyword": flag(before.rlike(rf"{TELLING}|(?i:bearer)")),
        "named": flag(before.rlike(rf"{ASSIGNS}$")),
        "assigned": flag(before.rlike(r"[=:]\s*[\"'`]?$")),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "digest_word": flag(F.lower(before).rlike("sha-?(?:1|256|512)|md5|checksum|commit|digest|revision|etag|integrity|uuid|guid|blob|hash")),
        "digest_like": flag(candidate.rlike(r"^(?i:sha[0-9]{1,3}[-:]|md5[-:]|[0-9a-f]{8}-[0-9a-f]{4}-)")),
        "example_word": flag(F.lower(F.concat_ws(" ", before, candidate, after)).rlike("example|dummy|placeholder|change_?me|your[_-]|xxxx|sample|redacted|0000000|123456789|must |should ")),
        "prefix_known": flag(candidate.rlike(r"^(?:AKIA[A-Z0-9]{12}|ASIA[A-Z0-9]{12}|gh[pousr]_|glpat-|sk_live_|sk-[A-Za-z0-9]{16}|xox[bp]-|eyJ|AIza|SG\.)")),
    }
    return [found[name].cast("double").alias(name) for name in FEATURES]


#: Where findings of each kind stand: before and after them.
_SECRET_AT = ('token = "', "password: ", "api_key='", "secret=", "Authorization: Bearer ", "auth_token: ", '"client_secret": "', 'DB_PASSWORD="', "AWS_SECRET_ACCESS_KEY=", "pwd=", "access-key: ", 'private_key = "')
_DIGEST_AT = ("commit ", "sha1: ", "sha256 ", "checksum = ", "revision ", 'etag: "', "md5 of file ", "the file ", "blob ", '"integrity": "', "see ", " of the ", "\n", " and ", "tree ")
_PLAIN_AT = (" and the ", ". ", ", ", " of ", "\n", " (", " in ", 'name = "', "import ", "id=", "see https://host/", "path: /usr/", "class ", "def ", "return ", 'title: "')
_SECRET_END, _PLAIN_END = ('"', "'", "\n", " ", '",', ""), (" ", ". ", ", ", "\n", "()", '"', ".html", "")
_SYLLABLES = "the on er tion ing an re ble st ou he in es ung ment eau cion ver".split()


def labelled_findings(spark: SparkSession, n: int = FINDINGS, first: int = 0) -> DataFrame:
    """(candidate, before, after, path, label): findings ``first`` to ``first + n`` by rule, the same in every run."""
    noise = lambda salt: F.sha2(F.concat_ws(":", F.lit(salt), F.col("id")), 256)
    draw = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(n))
    pick = lambda salt, of: F.element_at(F.array(*of), (draw(salt, len(of)) + 1).cast("int"))
    text = lambda values: [F.lit(v) for v in values]
    cut = lambda value, salt, low, high: F.substring(value, F.lit(1), (draw(salt, high - low + 1) + low).cast("int"))
    base64 = lambda salt: F.regexp_replace(F.base64(F.unhex(noise(salt))), "=", "")
    word = lambda salt: pick(salt, text(DICTIONARY))
    odd = lambda salt: pick(salt, text(_SYLLABLES))
    made = lambda salt, k: F.concat(*[odd(f"{salt}{i}") for i in range(k)])
    digits = lambda salt, n: draw(salt, 10**n).cast("string")
    hexes = F.substring(noise("h"), 1, 40), F.substring(noise("h"), 1, 32), noise("h")
    uuid = F.concat_ws("-", *[F.substring(noise("u"), a, k) for a, k in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    #: candidate, whether it is a secret, what stands before it
    kinds = [
        *[(h, 1, _SECRET_AT) for h in hexes],
        (cut(base64("b"), "n", 20, 40), 1, _SECRET_AT),
        (cut(base64("b"), "n", 20, 40), 1, _SECRET_AT),
        (F.concat(F.lit("AKIA"), F.substring(F.upper(F.regexp_replace(base64("b"), "[^A-Za-z0-9]", "Q")), 1, 16)), 1, _SECRET_AT + _PLAIN_AT[:7]),
        (F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(base64("b"), "[^A-Za-z0-9]", "x"), 1, 36)), 1, _SECRET_AT + _PLAIN_AT[:7]),
        (F.concat(F.lit("sk_live_"), F.substring(F.regexp_replace(base64("b"), "[^A-Za-z0-9]", "k"), 1, 24)), 1, _SECRET_AT + _PLAIN_AT[:7]),
        (F.concat(F.lit("eyJ"), *[F.regexp_replace(x, "[+/]", "_") for x in (base64("b"), F.lit("."), base64("c"), F.lit("."), base64("d"))]), 1, _SECRET_AT + _PLAIN_AT[:7]),
        (F.concat(F.initcap(word("w1")), digits("d1", 3), pick("s", text("!@#$%&*?"))), 1, _SECRET_AT),
        (F.concat(odd("o1"), digits("d1", 2), odd("o2"), digits("d2", 3)), 1, _SECRET_AT),
        (F.concat(cut(base64("b"), "n", 4, 9), pick("s", text("!@#$%&*?")), cut(base64("c"), "m", 3, 8)), 1, _SECRET_AT),
        (cut(F.regexp_replace(base64("b"), "[+/]", "7"), "n", 8, 16), 1, _SECRET_AT),
        (F.concat(odd("o1"), odd("o2"), digits("d1", 4), odd("o1"), odd("o2")), 1, _SECRET_AT),
        (F.concat(word("w1"), F.initcap(word("w2")), F.initcap(word("w3")), F.initcap(word("w4")), F.lit("Manager")), 0, _PLAIN_AT),
        (F.concat_ws("_", word("w1"), word("w2"), word("w3"), word("w4"), F.lit("value")), 0, _PLAIN_AT + _SECRET_AT),
        (made("o", 7), 0, _PLAIN_AT),
        (F.concat(F.initcap(odd("p0")), made("p", 8)), 0, _PLAIN_AT),
        *[(h, 0, _DIGEST_AT) for h in hexes],
        (uuid, 0, _DIGEST_AT + _PLAIN_AT),
        (F.concat(F.lit("sha512-"), base64("b"), base64("c"), F.lit("==")), 0, _DIGEST_AT + _PLAIN_AT),
        (F.concat_ws("/", word("w1"), word("w2"), word("w3"), F.lit("index")), 0, _PLAIN_AT),
        (F.concat(F.lit("4"), F.lpad(F.abs(F.xxhash64(F.lit("d"), "id")).cast("string"), 17, "4")), 0, _PLAIN_AT),
        (F.concat(F.lit("your_"), pick("y", text(("api_key", "token", "password", "secret"))), F.lit("_here")), 0, _SECRET_AT),
        (pick("x", text(("changeme", "example", "placeholder", "xxxxxxxxxxxx", "password", "required", "undefined", "redacted", "********", "dummy_value", "123456789"))), 0, _SECRET_AT),
        (F.concat_ws(".", word("w1"), word("w2")), 0, _SECRET_AT),
        (F.concat_ws("_", word("w1"), word("w2")), 0, _SECRET_AT),
        (F.concat(word("w1"), F.initcap(word("w2"))), 0, _SECRET_AT),
        (F.concat(F.lit("$"), F.upper(word("w1")), F.lit("_"), F.upper(word("w2"))), 0, _SECRET_AT),
        (made("o", 3), 0, _SECRET_AT),
        (F.repeat(pick("r", text(("x", "-", "0", "ab", "test"))), 20), 0, _PLAIN_AT + _SECRET_AT),
        (F.regexp_replace(F.upper(made("q", 9)), "Z", "E"), 0, _PLAIN_AT),
    ]
    parts = [
        spark.range(first + k, first + n, len(kinds), 1).select(
            made_of.alias("candidate"),
            pick("before", text(at)).alias("before"),
            pick("after", text(_SECRET_END if label else _PLAIN_END)).alias("after"),
            pick("path", text(("src1", "src/main", "config/prod", "docs/example", "tests/fixture", "app"))).alias("path"),
            F.lit(float(label)).alias("label"),
        )
        for k, (made_of, label, at) in enumerate(kinds)
    ]
    return materialise(reduce(DataFrame.unionByName, parts).coalesce(1), "findings")


def train(findings: DataFrame, words: list[str] | None = None) -> RandomForestClassificationModel:
    """A forest from labelled findings (candidate, before, after, path, label 0 or 1)."""
    rows = findings.select(*features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"), words), "label")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="x", labelCol="label", featureSubsetStrategy="sqrt")
    return forest.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows.coalesce(1)))


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """(doc_id, start, candidate, before, after, path) of each candidate; start counts characters from 0."""
    own = F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")
    rows = docs.select(
        "doc_id",
        own.alias("path"),
        F.monotonically_increasing_id().alias("row"),
        F.split("text", CANDIDATE, -1).alias("rest"),
        F.regexp_extract_all("text", F.lit(CANDIDATE), 0).alias("found"),
    ).filter(F.size("found") > 0)
    paired = rows.select(
        "doc_id", "path", "row", "found",
        F.concat(F.array(F.lit("")), F.transform("found", lambda x: F.right(x, F.lit(BEFORE)))).alias("last"),
        F.slice("rest", F.lit(1), F.size("found")).alias("b"), F.slice("rest", F.lit(2), F.size("found")).alias("a"),
    )
    zipped = F.arrays_zip("found", "b", "a", F.slice("last", F.lit(1), F.size("found")).alias("last"))
    each = paired.select("doc_id", "path", "row", F.posexplode(zipped).alias("k", "z")).select(
        "doc_id", "path", "row", "k", "z.found",
        F.regexp_extract("z.found", f"^{ASSIGNS}(?={VALUE}$)", 0).alias("name"),
        F.length("z.b").alias("ahead"),
        F.concat("z.last", "z.b").alias("before"),
        F.left("z.a", F.lit(AFTER)).alias("after"),
    )
    upto = Window.partitionBy("row").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = F.sum(F.col("ahead") + F.length("found")).over(upto)
    return each.withColumn("ends", ends).select(
        "doc_id", (F.col("ends") - F.length("found") + F.length("name")).cast("long").alias("start"),
        F.expr("substring(found, length(name) + 1)").alias("candidate"),
        F.right(F.concat("before", "name"), F.lit(BEFORE)).alias("before"), "after", "path",
    )


def scored(docs: DataFrame, model: RandomForestClassificationModel, path: str = "source", words: list[str] | None = None) -> DataFrame:
    """Every candidate of ``docs`` with ``score``, the forest's probability of a secret."""
    rows = candidates(docs, path)
    named = rows.select("*", *features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"), words))
    found = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(named))
    return found.select(*rows.columns, vector_to_array("probability")[1].alias("score"))


def scan(docs: DataFrame, findings: DataFrame | None = None, least: float = 0.5, path: str = "source") -> DataFrame:
    """(doc_id, start, length, secret_sha256, score) of the findings that the forest keeps."""
    words = dictionary_of(docs)
    model = train(labelled_findings(docs.sparkSession) if findings is None else findings, words)
    kept = scored(docs, model, path, words).filter(F.col("score") >= least)
    return kept.select(
        "doc_id", "start", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("secret_sha256"), F.round("score", 6).alias("score")
    )
