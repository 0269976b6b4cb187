"""Secret scan with a random forest that removes false findings.

Findings are runs of at least ``LEAST`` characters of the alphabet of keys that have a digit or mix cases, and values of at least ``SHORT``
characters, of any kind, that follow a naming word and ``=`` or ``:``, in the same word or in the one before. A run within a value is part of it.
Features of a finding are its length, how its characters follow each other (changes of kind, and log odds of pairs of characters), the shares of
digits, upper case and vowels, different characters, how much of it words cover, signs of a path, and what the neighbouring words name.
The words are the ``WORDS`` most frequent of all documents, by counts over whole texts, and fixed ones. The forest is grown on the driver
from at most ``LABELLED`` labelled findings, whose features the same expressions compute, and becomes one column expression; half of
them, by a hash, give the odds of pairs instead of growing trees. Nothing but built-in functions runs on the executors.

Labelled findings are a table (word, before, after, label); ``labelled_findings`` makes one from patterns of keys, passwords, digests, paths
and identifiers.

Defined results: a null or empty text has no finding; a very long text is one row throughout; repeated rows have their findings each;
a word with several findings has a row for each, numbered by ``part``; an empty table gives an empty result; labelled findings of which none is
a finding are refused.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST, SHORT, LABELLED, WORDS = 16, 6, 4000, 4000
RUN = rf"[A-Za-z0-9+/_\-]{{{LEAST},}}={{0,2}}"
#: A naming word and a sign of assignment; what may be in a value, up to a mark that closes it.
NAMING = r"(?i:key|secret|token|passw|passphrase|pwd|credential|auth|bearer)[A-Za-z0-9_\-]{0,40}+[\"')\]]{0,3}+ ?(?::=|=>|[=:])"
VALUE = rf"[\"']?([^\s\"'<>(){{}}\[\],;&]{{{SHORT},}})"
#: Words that are frequent in identifiers and prose.
DICTIONARY = (
    "access account action address admin array base block buffer build button cache call change channel check class client cluster code color column command common component "
    "config connection content context control count create data database date default delete device document driver element email entity entry error event example factory "
    "field file filter form frame from function global group handle handler header html http image index info input instance integer interface item java language last layer layout level "
    "library line link list load local lock login manager master memory menu message method mode model module name network node null number object option order output package page "
    "panel param parse path pattern pixel player point policy port process profile project property protocol provider proxy query queue read record reference region register remote render "
    "report request resource response result role root route sample schema screen script search select sequence server service session setting settings share site size source stack start "
    "state status store stream string style support switch system table target task template test text thread time title tool tree type update user util value vector version video view web "
    "widget window with word work write"
).split()
NAMES = r"(?i)(key|secret|token|passw|pwd|credential|auth|bearer|api)"
HARMLESS = r"(?i)(commit|sha|md5|checksum|digest|hash|uuid|guid|version|build|revision|file|path|dir|url|class|import)"

_KINDS = "L" * 26 + "U" * 26 + "D" * 10
_CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
#: Characters as the log odds of pairs know them: letters, one sign for digits, one for all else; in ASCII, one after another.
_SIGNS, _FIRST = 28, ord("a")


def candidates(word: Column, before: Column) -> Column:
    """The findings of a word that follows the words ``before``: its value, if it is one, then its runs outside the value."""
    inside = F.regexp_extract(word, NAMING + VALUE, 1)
    follows = F.when(before.rlike(NAMING + "$"), F.regexp_extract(word, "^" + VALUE, 1)).otherwise(F.lit(""))
    value = F.regexp_replace(F.when(inside != "", inside).otherwise(follows), "[.:]+$", "")
    runs = F.filter(F.regexp_extract_all(word, F.lit(RUN), 0), lambda r: (r.rlike("[0-9]") | r.rlike("[a-z][A-Z]") & r.rlike("[A-Z]{2}")) & ~F.contains(value, r))
    return F.concat(F.when(F.length(value) >= SHORT, F.array(value)).otherwise(F.array().cast("array<string>")), runs)


def _signs(run: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(run), "[0-9]", "{"), "[^a-z{]", "|")


def pair_odds(findings: list[str], secret: list[int]) -> list[float]:
    """Log odds that a secret, not a false finding, has a character after another: (first, second) in row order. ``findings`` are of ``_signs``."""
    counts = np.ones((2, _SIGNS, _SIGNS))
    for signs, label in zip(findings, secret):
        c = np.frombuffer(signs.encode(), np.uint8).astype(int) - _FIRST
        np.add.at(counts[int(bool(label))], (c[:-1], c[1:]), 1)
    logs = np.log(counts / counts.sum(axis=2, keepdims=True))
    return (logs[1] - logs[0]).ravel().tolist()


def _is_word(words: list[str]):
    """Whether a text is one of the words, which are a literal array of lists by hash: two literals at any number of words."""
    lists = [" "] * max(1, len(words) // 4)
    for w in words:
        lists[zlib.crc32(w.encode()) % len(lists)] += w + " "
    table = F.split(F.lit("/".join(lists)), "/")
    return lambda text: F.contains(F.get(table, (F.crc32(text) % len(lists)).cast("int")), F.concat(F.lit(" "), text, F.lit(" ")))


def features(run: Column, word: Column, before: Column, after: Column, words: list[str], odds: list[float]) -> dict[str, Column]:
    kinds = F.translate(run, _CHARS, _KINDS)
    n = F.length(run).cast("double")
    lower = F.lower(run)
    parts = F.regexp_extract_all(run, F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}"), 0)
    covered = F.aggregate(F.filter(F.transform(parts, F.lower), _is_word(words)), F.lit(0), lambda total, p: total + F.length(p))
    around = F.concat_ws(" ", before, F.replace(word, run, F.lit(" ")))
    signs = F.transform(F.split(_signs(run), ""), lambda c: F.ascii(c) - _FIRST)
    table = F.split(F.lit(" ".join(map(repr, odds))), " ").cast("array<double>")
    pairs = F.zip_with(F.slice(signs, 1, F.size(signs) - 1), F.slice(signs, 2, F.size(signs) - 1), lambda a, b: F.get(table, a * _SIGNS + b))

    def share(pattern: str, text: Column = run) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / n

    return {
        "length": n,
        "changes": (F.regexp_count(kinds, F.lit("L+|U+|D+|[^LUD]+")) - 1) / n,
        "pairs": F.aggregate(pairs, F.lit(0.0), lambda total, o: total + o) / n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "vowels": share("[aeiou]", lower),
        "different": F.size(F.array_distinct(F.split(run, ""))) / n,
        "dictionary": covered / n,
        "slashes": share("[/]"),
        "joints": share("[_-]"),
        "signs": share("[^A-Za-z0-9/_-]"),
        "hex": run.rlike("^[0-9a-f]+$|^[0-9A-F]+$").cast("double"),
        "path": word.rlike(r"://|^[./~]|/.*/|\.[A-Za-z]{1,4}$").cast("double"),
        "named": around.rlike(NAMES).cast("double"),
        "harmless": around.rlike(HARMLESS).cast("double"),
        "assigned": around.rlike(r"[=:]").cast("double"),
        "follows": after.rlike(HARMLESS).cast("double"),
    }


def frequent_words(docs: DataFrame, text_col: str = "text", n: int = WORDS) -> list[str]:
    """The n most frequent words of 3 to 20 letters, lower-cased, of all texts, with the fixed ones."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), F.lit(r"(?<![a-z0-9_+/=-])[a-z]{3,20}+(?![a-z0-9_+/=-])"), 0)
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").count()
    return sorted(set(DICTIONARY) | {r["word"] for r in counts.orderBy(F.desc("count"), "word").limit(n).collect()})


def labelled_findings(spark: SparkSession, n: int = LABELLED, seed: int = 42) -> DataFrame:
    """Made-up findings, as (word, before, after, label), half of them secrets."""
    i = F.col("id")

    def hexed(salt: str) -> Column:
        return F.sha2(F.concat_ws("/", F.lit(f"{seed}{salt}"), i), 256)

    def pick(salt: str, *values: str) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(F.lit(f"{seed}{salt}"), i), F.lit(len(values))) + 1).cast("int"))

    def text(salt: str) -> Column:
        return F.regexp_replace(F.base64(F.unhex(hexed(salt))), "=", "")

    def mixed(salt: str, a: int) -> Column:
        return F.substring(F.concat(F.regexp_replace(text(salt), "[+/]", "x"), F.regexp_replace(text(salt + "b"), "[+/]", "y")), 1, a)

    words = [pick(f"w{k}", *DICTIONARY) for k in range(5)]
    caps = [F.initcap(w) for w in words]
    quiet = pick("q", "the", "is", "see", "of", "value", "and", "=", "")
    named = pick("n", "api_key =", "token =", "secret:", "password:", "auth_token =", "key =", "Bearer", "the key is", "credentials", "API key:")
    harmless = pick("c", "commit", "sha256:", "md5", "checksum", "build", "revision", "digest =", "version", "file", "uuid")
    positive = [
        (F.concat(F.lit("AKIA"), F.upper(F.translate(mixed("p1", 16), "abcdefghijklmnopqrstuvwxyz0189", "ABCDEFGHIJKLMNOPQRSTUVWXYZ2345"))), pick("b1", "", "key", "the", "id =", "aws", "use")),
        (F.concat(F.lit('"'), F.substring(hexed("p2"), 1, 40), F.lit('"')), named),
        (F.concat(pick("b3", "password=", "token=", "secret=", "api_key=", "passwd:", "key:"), F.substring(hexed("p3"), 1, 18)), quiet),
        (mixed("p4", 40), named),
        (F.concat(F.lit("ghp_"), mixed("p5", 36)), quiet),
        (F.concat(F.lit("sk_live_"), mixed("p6", 24)), quiet),
        (F.concat(pick("b7", "password=", "token=", "secret="), mixed("p7", 20)), quiet),
        (text("p8"), named),
    ]
    negative = [
        (F.substring(hexed("n1"), 1, 40), harmless),
        (F.substring(hexed("n2"), 1, 32), harmless),
        (F.concat_ws("/", F.lit(""), *words[:4], F.concat(words[4], F.substring(hexed("n3"), 1, 2))), quiet),
        (F.concat(words[0], *caps[1:4], F.substring(hexed("n4"), 1, 1)), quiet),
        (F.concat_ws("_", *words[:3], F.substring(hexed("n5"), 1, 2)), quiet),
        (F.concat(F.lit("https://"), words[0], F.lit(".example.org/"), F.concat_ws("/", *words[1:4], F.substring(hexed("n6"), 1, 8))), quiet),
        (F.concat_ws("-", F.substring(hexed("n7"), 1, 8), F.substring(hexed("n7"), 9, 4), F.substring(hexed("n7"), 13, 4), F.substring(hexed("n7"), 17, 12)), harmless),
        (F.concat_ws("-", words[0], words[1], F.lit("2"), F.substring(F.conv(F.substring(hexed("n8"), 1, 8), 16, 10), 1, 4), words[2]), quiet),
    ]
    negative.append((F.concat(*(F.substring(F.conv(F.substring(hexed("n9"), a, 8), 16, 10), -4, 4) for a in (1, 9, 17, 25))), quiet))
    positive.append((F.concat(F.lit("xoxb-"), mixed("p9", 24)), quiet))
    # Short values after a naming word, and what else stands there.
    sets_ = ("password=", "passwd=", "pwd:", "secret=", "auth_token:", "api_key=", "PASSWORD=")
    ends = ("password:", "the password =", "secret:", "api_key =", "token:", "credentials:", "passphrase:")
    digits = F.substring(F.conv(F.substring(hexed("d"), 1, 8), 16, 10), 1, 4)
    letters = F.translate(F.substring(hexed("l"), 1, 40), "0123456789", "ghijklmnop")
    more = F.translate(F.substring(hexed("m"), 1, 40), "0123456789abcdef", "qrstuvwxyzhkmpbc")
    sign = pick("s", "!", "@", "#", "$", "%", "*", "-", "")
    lines = F.concat(F.substring(letters, 1, 7), F.substring(more, 3, 7), F.substring(letters, 21, 4), F.substring(more, 31, 4))
    positive += [
        (F.concat(pick("a1", *sets_), mixed("s1", 8), sign, digits), quiet),
        (F.concat(mixed("s2", 7), sign, F.substring(digits, 1, 3)), pick("a2", *ends)),
        (F.concat(pick("a3", *sets_), caps[0], sign, digits, pick("a4", "!", "?", "#", "x")), quiet),
        (F.concat(F.translate(caps[1], "aeios", "@3105"), sign, digits), pick("a5", *ends)),
        (F.concat(pick("a6", *sets_), lines), quiet),
        (lines, pick("a7", *ends)),
    ]
    joint = pick("j", "_", "-", ".", "/")
    none = pick("h", "********", "xxxxxxxxxxxx", "changeme", "YOUR_API_KEY", "REDACTED", "example-token", "undefined", "optional", "required", "string", "password", "your_password_here", "<hidden>")
    negative += [
        (F.concat(pick("a1", *sets_), none), quiet),
        (none, pick("a2", *ends)),
        (F.concat(words[0], pick("e1", "ing", "ed", "able", "ment", "ation", "ity", "er")), pick("a5", *ends)),
        (F.concat(pick("a6", *sets_, "author:", "keyword:", "keyboard="), words[1], joint, words[2]), quiet),
        (F.concat(pick("a3", *sets_, "tokenizer=", "token_type:"), words[3], caps[4]), quiet),
        (F.concat_ws(".", *(F.substring(F.conv(F.substring(hexed("v"), a, 2), 16, 10), 1, 2) for a in (1, 3, 5))), pick("a7", "key:", "auth =", "token:", "author:")),
    ]
    cases = [(w, b, 1) for w, b in positive] + [(w, b, 0) for w, b in negative]
    choice = F.pmod(i, F.lit(len(cases)))

    chosen = F.lit(None)
    for k, (word, before, label) in enumerate(cases):
        chosen = F.when(choice == k, F.struct(word.alias("word"), before.alias("before"), F.lit("").alias("after"), F.lit(label).alias("label"))).otherwise(chosen)
    # Exploded, so that the choice is made once and not again for every use of its fields.
    return spark.range(n).select(F.explode(F.array(chosen)).alias("case")).select("case.*")


class Tree:
    """A classification tree of (feature, threshold, left, right) nodes and leaf probabilities."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator, tried: int):
        self.probability = float(y.mean())
        self.feature = None
        if depth == 0 or len(y) < 8 or self.probability in (0.0, 1.0):
            return
        best = (1e-9, None, 0.0)
        for f in rng.permutation(x.shape[1])[:tried]:
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y))
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            left, right = n[cut], len(y) - n[cut]
            p, q = ones[cut] / left, (ones[-1] - ones[cut]) / right
            gain = self.probability * (1 - self.probability) - (left * p * (1 - p) + right * q * (1 - q)) / len(y)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], int(f), float((v[cut[k]] + v[cut[k] + 1]) / 2))
        if best[1] is None:
            return
        _, self.feature, self.threshold = best
        low = x[:, self.feature] <= self.threshold
        self.low, self.high = (Tree(x[m], y[m], depth - 1, rng, tried) for m in (low, ~low))

    def expression(self, columns: list[Column]) -> Column:
        if self.feature is None:
            return F.lit(self.probability)
        return F.when(columns[self.feature] <= self.threshold, self.low.expression(columns)).otherwise(self.high.expression(columns))

    def predict(self, row: np.ndarray) -> float:
        if self.feature is None:
            return self.probability
        return (self.low if row[self.feature] <= self.threshold else self.high).predict(row)


class Forest:
    def __init__(self, names: list[str], x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 5, seed: int = 42):
        self.names = names
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            some = rng.integers(0, len(y), len(y))
            self.trees.append(Tree(x[some], y[some].astype(float), depth, rng, max(2, int(np.sqrt(x.shape[1])) + 1)))

    def expression(self) -> Column:
        columns = [F.col(n) for n in self.names]
        return reduce(lambda a, b: a + b, (t.expression(columns) for t in self.trees)) / len(self.trees)

    def predict(self, row: np.ndarray) -> float:
        return sum(t.predict(row) for t in self.trees) / len(self.trees)


def train(labelled: DataFrame, words: list[str] = DICTIONARY, **options) -> tuple[Forest, list[float]]:
    """A forest, and the odds of pairs, of at most ``LABELLED`` labelled findings (those of smallest hash)."""
    found = labelled.filter(F.col("label").isNotNull()).select("word", "before", "after", F.col("label").cast("int").alias("label"), F.explode(F.slice(candidates(F.col("word"), F.col("before")), 1, 1)).alias("run"))
    some = found.orderBy(F.xxhash64("word", "before", "after"), "word", "before", "after", "label").limit(LABELLED)
    half = F.pmod(F.xxhash64("after", "before", "word"), F.lit(2))
    rows = some.select(_signs(F.col("run")).alias("signs"), "label", half.alias("half")).collect()
    if not rows:
        raise ValueError("no labelled findings")
    apart = all(len({r["label"] for r in rows if r["half"] == h}) == 2 for h in (0, 1))
    first = [r for r in rows if r["half"] == 0 or not apart]
    odds = pair_odds([r["signs"] for r in first], [r["label"] for r in first])
    second = some.filter(half == 1) if apart else some
    named = second.select(*(c.alias(n) for n, c in features(F.col("run"), F.col("word"), F.col("before"), F.col("after"), words, odds).items()), "label").collect()
    names = list(named[0].asDict())[:-1]
    x = np.array([[float(r[n]) for n in names] for r in named])
    return Forest(names, x, np.array([r["label"] for r in named]), **options), odds


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word_no, word, before, after, part, run): all findings before the forest."""
    split = F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+")

    def may(no: Column) -> Column:
        word, last = F.get("words", no), F.coalesce(F.get("words", no - 1), F.lit(""))
        run = (F.length(word) >= LEAST) & word.rlike(RUN)
        return run | (F.contains(word, F.lit("=")) | F.contains(word, F.lit(":"))) & word.rlike(NAMING) | last.rlike("[=:>]$") & (F.length(word) >= SHORT)

    def near(no: Column) -> Column:
        before = F.concat_ws(" ", *(F.coalesce(F.get("words", no - d), F.lit("")) for d in (3, 2, 1)))
        return F.struct(no.alias("word_no"), F.get("words", no).alias("word"), before.alias("before"), F.coalesce(F.get("words", no + 1), F.lit("")).alias("after"))

    # Only a word and its neighbours leave the row, never the array of all words.
    hits = F.transform(F.filter(F.sequence(F.lit(0), F.size("words") - 1), may), near)
    found = docs.select(F.col(id_col).alias("id"), split.alias("words")).select("id", F.explode(hits).alias("hit")).select("id", "hit.*")
    return found.select("*", F.posexplode(candidates(F.col("word"), F.col("before"))).alias("part", "run"))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, labelled: DataFrame | None = None, threshold: float = 0.5, **options) -> DataFrame:
    """(id, word_no, part, finding, score, is_secret) of all findings."""
    words = frequent_words(docs, text_col)
    forest, odds = train(labelled if labelled is not None else labelled_findings(docs.sparkSession), words, **options)
    found = findings(docs, id_col, text_col)
    named = found.select("id", "word_no", "part", "run", *(c.alias(n) for n, c in features(F.col("run"), F.col("word"), F.col("before"), F.col("after"), words, odds).items()))
    return named.select(F.col("id").alias(id_col), "word_no", "part", F.col("run").alias("finding"), forest.expression().alias("score")).withColumn("is_secret", F.col("score") >= threshold)
