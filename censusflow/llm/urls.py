"""URL filters: rules first, then words in the host judged by naive Bayes.

Host and path are cut by native expressions. The host's labels are split into words by the most likely segmentation under a
unigram dictionary (Viterbi), and a multinomial naive Bayes model scores host words and path tokens. The dictionary is a short
list of common words and the most frequent hyphen-separated host words and path words of the table, of 2 to LETTERS letters.
Rows to which a rule applies teach the model: the rule's verdict is their label. Where no rule fits, the model's verdict
counts: block if it is likelier than not.

Both tables are aggregated over all rows, and totals, sums and vocabulary are those of all entries. The most frequent `top`
entries of each (a fixed number) are sent to tasks; the others are looked up by keyed joins, of each host's substrings and of
each (host, path)'s tokens, so the number sent changes no result.

Defined cases: a null url or one without :// has an empty host and path and is judged by the prior alone; without rows under
rules all others are allowed; repeated rows teach and are judged each; columns beside page_id, url and those that `teaches`
reads are left out; very long hosts and paths are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import ChainMap, Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censusflow.llm.common import kept

# Fixed values of the contract: rules and verdicts.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
# Common words of host names and paths that the dictionary always has.
PLAIN = "www blog mail shop news home page index article example test site web online free best world the and of in on to".split()
TOP, LETTERS, UNKNOWN, PER_LETTER = 50_000, 40, -9.0, -1.6
_WORD = re.compile(r"[^\W\d_]+|\d+")


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. For lists of up to some hundred rules."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def path_tokens(path: str) -> list[str]:
    return ["#" if w.isdigit() else w for w in _WORD.findall(path.lower())]


def labels(host: str) -> list[str]:
    return re.findall(r"[^\W_]+", host)


class Segmenter:
    """Most likely split of a name into dictionary words; a stretch of unknown letters costs by its length."""

    def __init__(self, counts: dict[str, int], total: int, longest: int):
        self.total, self.longest = total, longest
        self.cost = {w: self.cost_of(c) for w, c in counts.items() if len(w) > 1}
        self.known: dict[str, list[str]] = {}

    def cost_of(self, c: int) -> float:
        return math.log((c + 1) / self.total)

    def split(self, name: str, extra: dict[str, float]) -> list[str]:
        if name not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[name] = self._viterbi(name, extra)
        return self.known[name]

    def _viterbi(self, name: str, extra: dict[str, float]) -> list[str]:
        cost = ChainMap(extra, self.cost) if extra else self.cost
        # the best way to each place that ends with a word, and the best that ends inside an unknown stretch: cost, where the last part starts
        word, inside = [(0.0, 0)], [(-math.inf, 0)]
        for j in range(1, len(name) + 1):
            known = [(max(word[i][0], inside[i][0]) + cost[name[i:j]], i) for i in range(max(0, j - self.longest), j) if name[i:j] in cost]
            word.append(max(known, default=(-math.inf, 0)))
            inside.append(max((inside[j - 1][0], inside[j - 1][1]), (word[j - 1][0] + UNKNOWN, j - 1)))
            inside[j] = (inside[j][0] + PER_LETTER, inside[j][1])
        out, j, was_word = [], len(name), True
        while j:
            # a stretch begins after a word, so before one of them only a word can end
            of_word = word[j][0] >= inside[j][0] if was_word else True
            i = (word if of_word else inside)[j][1]
            out.append(name[i:j])
            j, was_word = i, of_word
        return out[::-1]

    def host(self, host: str, extra: list[dict] | None = None) -> list[str]:
        """Words of a host; extra: dictionary words in it that weren't sent."""
        more = {r["word"]: self.cost_of(r["c"]) for r in extra or ()}
        return [w for label in labels(host) for w in self.split(label, more)]


def _counted(counts: Counter, names=("word", "c")) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=list(names))


def _dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
            for label in host.split("."):
                if "-" in label:
                    counts.update(w for w in re.findall(r"[^\W\d_]+", label) if 2 <= len(w) <= LETTERS)
            counts.update(w for w in path_tokens(path) if w != "#" and 2 <= len(w) <= LETTERS)
        if len(counts) > 200_000:
            yield _counted(counts)
            counts = Counter()
    yield _counted(counts)


def _substrings(sent):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, _, longest = sent.value
        for batch in batches:
            hosts, subs = [], []
            for host in batch.column("host").to_pylist():
                every = {x[i:j] for x in labels(host) for i in range(len(x) - 1) for j in range(i + 2, min(len(x), i + longest) + 1)}
                every.difference_update(words)
                hosts += [host] * len(every)
                subs += every
                if len(subs) > 100_000:
                    yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(subs, pa.string())], names=["host", "word"])
                    hosts, subs = [], []
            yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(subs, pa.string())], names=["host", "word"])

    return work


def _rows(batch: pa.RecordBatch, seg: Segmenter) -> Iterator[tuple[str, str, list[str]]]:
    """Host, path and host words of each row."""
    for host, path, extra in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "extra")), strict=True):
        yield host, path, seg.host(host, extra)


def _teach(sent):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, counts = Segmenter(*sent.value), Counter()
        for batch in batches:
            for kind, (_, path, words) in zip(batch.column("kind").to_pylist(), _rows(batch, seg), strict=True):
                counts.update(f"{kind}h:{w}" for w in words)
                counts.update(f"{kind}p:{w}" for w in path_tokens(path))
                counts[kind] += 1
            if len(counts) > 200_000:
                yield _counted(counts)
                counts = Counter()
        yield _counted(counts)

    return work


class Bayes:
    """counts: of each token sent, those of allow and block. rows, sums: of all rows and tokens by kind."""

    def __init__(self, counts: dict[str, tuple[int, int]], rows: dict[str, int], sums: dict[str, int], vocabulary: int):
        self.counts = counts
        self.a, self.b = (sums[k] + vocabulary + 1 for k in "ab")
        self.prior = math.log((rows["b"] + 1) / (sum(rows.values()) + 2)) - math.log((rows["a"] + 1) / (sum(rows.values()) + 2))

    @staticmethod
    def tokens(host: list[str], path: list[str]) -> list[str]:
        return [*(f"h:{w}" for w in host), *(f"p:{w}" for w in path)]

    def block(self, tokens: list[str], more: float) -> float:
        """Probability of block; more: the terms of tokens that weren't sent."""
        s = self.prior + more
        for t in tokens:
            if t in self.counts:
                a, b = self.counts[t]
                s += math.log((b + 1) / self.b) - math.log((a + 1) / self.a)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, s))))


def _rest(sent, model):
    """Tokens of each (host, path) that weren't sent."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, known = Segmenter(*sent.value), model.value[0]
        for batch in batches:
            out = [(h, p, t, n) for h, p, ws in _rows(batch, seg) for t, n in Counter(Bayes.tokens(ws, path_tokens(p))).items() if t not in known]
            types = (pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["host", "path", "token", "n"])

    return work


def _judge(words, model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, bayes = Segmenter(*words.value), Bayes(*model.value)
        for batch in batches:
            rows = list(_rows(batch, seg))
            scores = [bayes.block(bayes.tokens(ws, path_tokens(p)), more or 0.0) for (_, p, ws), more in zip(rows, batch.column("more").to_pylist(), strict=True)]
            cols = [batch.column(c) for c in ("page_id", "host", "path", "rule", "said")]
            yield pa.record_batch([*cols, pa.array(scores, pa.float64()), pa.array([" ".join(ws) for _, _, ws in rows], pa.string())], names=["page_id", "host", "path", "rule", "said", "score", "words"])

    return work


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, top: int = TOP, teaches: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score (probability of block), words (the host's).

    teaches: which of the rows under rules teach the model; all if not given.
    """
    spark = pages.sparkSession
    teaches = F.lit(True) if teaches is None else F.coalesce(teaches, F.lit(False))
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), teaches.alias("teaches"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    broadcast = spark.sparkContext.broadcast

    found = kept(parts.select("host", "path").mapInArrow(_dictionary, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "dictionary")
    all_ = found.agg(F.count("*").alias("n"), F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.coalesce(F.max("c"), F.lit(1)).alias("most"), F.coalesce(F.max(F.length("word")), F.lit(1)).alias("longest")).first()
    seeds = PLAIN
    dictionary = {r["word"]: r["c"] for r in found.orderBy(F.desc("c"), "word").limit(top).collect()}
    dictionary |= {r["word"]: r["c"] for r in found.where(F.col("word").isin(seeds)).collect()}
    total = all_["c"] + 1
    for w in seeds:
        had = dictionary.get(w, 0)
        dictionary[w] = max(had, 1 + all_["most"] // 100)
        total += dictionary[w] - had
    words = broadcast((dictionary, total, max(all_["longest"], *map(len, seeds))))
    if all_["n"] > top:
        rare = parts.select("host").distinct().mapInArrow(_substrings(words), "host string, word string").join(found, "word")
        parts = kept(parts.join(rare.groupBy("host").agg(F.collect_list(F.struct("word", "c")).alias("extra")), "host", "left"), "pages")
    else:
        parts = parts.withColumn("extra", F.lit(None).cast("array<struct<word:string,c:bigint>>"))
    pair = parts.select("host", "path", "extra")

    lessons = parts.select("host", "path", "extra", F.when(says == "block", F.lit("b")).otherwise(F.lit("a")).alias("kind")).where(rule.isNotNull() & F.col("teaches"))
    taught = kept(lessons.mapInArrow(_teach(words), "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "taught")
    rows = {"a": 0, "b": 0} | {r["word"]: r["c"] for r in taught.where("length(word) = 1").collect()}
    a, b = (F.sum(F.when(F.col("word").startswith(k), F.col("c")).otherwise(0)).alias(k) for k in "ab")
    tokens = kept(taught.where("length(word) > 1").groupBy(F.expr("substring(word, 2)").alias("token")).agg(a, b), "tokens")
    every = tokens.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    counts = {r["token"]: (r["a"], r["b"]) for r in tokens.orderBy(F.desc(F.col("a") + F.col("b")), "token").limit(top).collect()}
    model = broadcast((counts, rows, {k: every[k] for k in "ab"}, every["n"]))
    if every["n"] > top:
        n = every["n"] + 1
        term = F.log((F.col("b") + 1) / F.lit(every["b"] + n)) - F.log((F.col("a") + 1) / F.lit(every["a"] + n))
        more = pair.dropDuplicates(["host", "path"]).mapInArrow(_rest(words, model), "host string, path string, token string, n long").join(tokens, "token").groupBy("host", "path").agg(F.sum(F.col("n") * term).alias("more"))
        parts = parts.join(more, ["host", "path"], "left")
    else:
        parts = parts.withColumn("more", F.lit(0.0))
    out = parts.select("page_id", "host", "path", rule.alias("rule"), says.alias("said"), "extra", "more").mapInArrow(_judge(words, model), "page_id long, host string, path string, rule string, said string, score double, words string")
    verdict = F.coalesce("said", F.when(F.col("score") > 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", "words")
