"""Quality classifier: a weak-label model and a hashed linear scorer.

Overlapping labellers vote on a bounded sample. Expectation-maximisation estimates from their votes alone how each votes
on good and on bad texts; the posteriors of the sample's texts then train a linear scorer over hashed words, word
beginnings and byte-class pairs, which scores every text. The same is done a second time for toxicity. Annotators, where
there are any, are one more labeller, who isn't asked where they haven't looked and is believed as far as the votes of all
bear them out. A share of their labels is withheld from that and measures what came out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import toxicity
from tidewatch.llm.common import discard, sliced, strings, written
from tidewatch.llm.hashing import word_hashes

#: Bound of the sample (smallest hashes of the id; labelled texts first, up to half of it), buckets of the words, and texts a feature must be in to count.
SAMPLE, BUCKETS, SUPPORT = 12_000, 1 << 16, 5
#: Tasks that train side by side, rounds after which their weights are averaged, and passes of each over its rows in a round.
WORKERS, ROUNDS, PASSES = 4, 12, 5
#: One label of so many is withheld, by the hash of the id.
WITHHELD = 5
#: Texts are kept from this quality on and below this toxicity: clean texts matter more.
POOR, TOXIC = 0.5, 0.7
#: Word beginnings (bytes), byte-class pairs, and shares by the name of SHARES.
PREFIXES, PAIRS = (5, 7), 256
SHARES = ("stutter", "symbols", "upper", "bangs", "pipes")
SIZE = BUCKETS + PAIRS + len(SHARES)
#: Common insults, swear words by their beginnings, contempt and threats, each for a labeller of its own.
INSULTS = ("clown", "disgusting", "fool", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
SWEARING = ("asshole", "bastard", "bitch", "bullshit", "cunt", "dickhead", "fuck", "goddamn", "motherfuck", "piss", "shit", "slut", "wanker", "whore")
CONTEMPT = re.compile(r"\b(shut up|get lost|go to hell|nobody (likes|wants|asked) you|i hate you|hate you all|you people|you make me sick|you disgust|shame on you|your kind|(you|they)( are|'re|r) (all |just |such |so |really |nothing but |an? |the )*(\w+ )?(ass|clowns?|disgrace|disgusting|dumb|fools?|garbage|idiots?|jokes?|liars?|losers?|morons?|nobody|pathetic|pigs?|scum|stupid|trash|ugly|useless|vermin|worthless))\b")
THREATS = re.compile(r"\b(i('ll| will|'m going to| am going to| hope (you|they)( will)?) (die|kill|hurt|beat|find you|burn|destroy you|suffer)|kill (yourself|yourselves|them all|you)|you (should|will|deserve to) (die|burn|suffer|pay for this)|drop dead|watch your back)\b")
#: Function words of English, and of other languages in which the lists above are of no use.
ENGLISH = frozenset("the of and to in is that was for with".split())
OTHER = frozenset("der die das und ist nicht ein eine mit auf le la les des et est une dans de el los las que y en del por".split())
ABSTAIN, GOOD, BAD, NOT_ASKED = 0, 1, 2, 3
#: Names of the labellers, in the order of their votes.
QUALITY_LABELLERS = ("symbols", "shouting", "exclamation", "stutter", "repeated_lines", "word_length", "pipes", "nothing_odd", "annotator")
TOXIC_LABELLERS = ("lexicon", "swearing", "contempt", "threats", "nothing_rude", "beginnings", "annotator")
#: Scores of segments beyond FREE add up; a text with SHARED of them is objected to, one with next to none is voted for.
FREE, SHARED, NONE = 1.0, 2.5, 0.5
_CLASS = np.full(256, 15, np.uint8)  # byte classes: white, line end, upper, lower, digit, then punctuation by kind, other bytes
for _k, _chars in enumerate((b" \t\r\x0b\x0c", b"\n", bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b".,;:", b"!", b"?", b"'\"", b"#*$%&", b"|", b"<>", b"()[]{}", b"-_/\\", b"@=+~^`")):
    _CLASS[list(_chars)] = _k


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, value, number of the text) of each nonzero feature, by text: 1 for each bucket of a word or a word's
    beginning that the text has, the shares of byte-class pairs, times four, and the SHARES, times eight."""
    coded = [t.encode() for t in texts]
    n = len(texts)
    words = [word_hashes([t.lower() for t in coded], p) for p in PREFIXES]
    whole = words[0]
    shift = np.uint64(64 - 16)
    bucket = np.concatenate([whole.hash, *(w.prefix for w in words)]) >> shift
    have = np.unique(np.tile(whole.text, 1 + len(PREFIXES)) * BUCKETS + bucket.astype(np.int64))
    sizes = np.array([len(t) for t in coded], np.int64)
    kinds = _CLASS[np.frombuffer(b"".join(coded), np.uint8)].astype(np.int64)
    text_of = np.repeat(np.arange(n), sizes)
    inside = np.flatnonzero(text_of[1:] == text_of[:-1])
    pairs = np.bincount(text_of[inside] * PAIRS + kinds[inside] * 16 + kinds[inside + 1], minlength=n * PAIRS).reshape(n, PAIRS)
    t, p = np.nonzero(pairs)
    by_kind = np.bincount(text_of * 16 + kinds, minlength=n * 16).reshape(n, 16)
    letters = np.maximum(1, by_kind[:, 2] + by_kind[:, 3])
    counts = np.maximum(1, whole.counts)
    same = np.flatnonzero((whole.hash[1:] == whole.hash[:-1]) & (whole.text[1:] == whole.text[:-1]))
    shares = np.stack([np.bincount(whole.text[same], minlength=n) / counts, (by_kind[:, 9] + by_kind[:, 11]) / letters, by_kind[:, 2] / letters, by_kind[:, 6] / counts, by_kind[:, 10] / counts], axis=1)
    u, k = np.nonzero(shares)
    index = np.concatenate([have % BUCKETS, BUCKETS + p, BUCKETS + PAIRS + k])
    value = np.concatenate([np.ones(len(have)), 4.0 * pairs[t, p] / np.maximum(sizes[t] - 1, 1), 8.0 * np.minimum(shares[u, k], 1.0)])
    text = np.concatenate([have // BUCKETS, t, u])
    order = np.argsort(text, kind="stable")
    return index[order], value[order], text[order]


def scaled(index: np.ndarray, value: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Values with those of words divided by the root of their number in the text, shares weighted up: quality is a matter of shares,
    toxicity of single words."""
    words = index < BUCKETS
    count = np.bincount(text[words], minlength=n)
    return np.where(words, value * 3.0 / np.sqrt(np.maximum(count, 9))[text], 4.0 * value)


def votes(text: str) -> tuple[list[int], list[int]]:
    """Votes of the heuristic labellers, without the annotators, on quality and on toxicity. Each symptom's labeller
    can only object; that no symptom shows at all is one labeller's vote for the text, for quality and for toxicity. The word lists are
    English: in a text with more function words of other languages they find nothing or aren't asked (NOT_ASKED)."""
    words = text.split()
    n, chars = len(words), max(1, sum(map(len, words)))
    if not n:
        return [ABSTAIN] * 5 + [BAD, ABSTAIN, ABSTAIN], [ABSTAIN] * 4 + [GOOD]
    letters = max(1, sum(c.isalpha() for c in text))
    lines = [x for x in text.split("\n") if x.strip()]
    shares = (
        (sum(text.count(c) for c in "#*$%&<>") / chars, 0.03),
        (sum(c.isupper() for c in text) / letters if letters > 20 else 0.0, 0.35),
        (text.count("!") / n, 0.15),
        (sum(a == b for a, b in zip(words, words[1:])) / n if n > 9 else 0.0, 0.15),
        (1 - len(set(lines)) / len(lines) if len(lines) > 3 else 0.0, 0.4),
        (max(1.5 - chars / n, chars / n - 20, 0.0), 0.0),
        (words.count("|") / n, 0.15),
    )
    odd = [BAD if x > most else ABSTAIN for x, most in shares]
    clean = GOOD if all(x <= 0.4 * most for x, most in shares) else ABSTAIN
    bare = [w.strip(".,;:!?'\"()").lower() for w in words]
    plain = " ".join(text.lower().replace("\u2019", "'").split())
    rude = [any(w in INSULTS for w in bare), any(w.startswith(SWEARING) for w in bare), bool(CONTEMPT.search(plain)), bool(THREATS.search(plain))]
    silent = NOT_ASKED if sum(w in OTHER for w in bare) > sum(w in ENGLISH for w in bare) else ABSTAIN
    return [*odd, clean], [*(BAD if x else silent for x in rude), ABSTAIN if any(rude) else NOT_ASKED if silent else GOOD]


def beginnings(texts: list[str], folds: list[int], models: dict[int, toxicity.Model]) -> list[int]:
    """Votes on toxicity by the words' beginnings that toxic texts of other folds share (fold -1: of all)."""
    out, fold = [NOT_ASKED] * len(texts), np.array(folds)
    for k in np.unique(fold).tolist():
        own = np.flatnonzero(fold == k)
        if not models[k].toxic.any():
            continue
        found = toxicity.scan([texts[i] for i in own], models[k])
        strong = np.bincount(found.text, weights=np.maximum(found.score - FREE, 0), minlength=len(own))
        for i, x in zip(own.tolist(), strong.tolist()):
            out[i] = BAD if x >= SHARED else GOOD if x < NONE else ABSTAIN
    return out


def expectation_maximisation(vote: np.ndarray, weight: np.ndarray | None = None, rounds: int = 60, prior: float = 0.15) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of bad for each row, table[labeller, class, vote]) of a two-class model whose labellers vote
    independently given the class; that a labeller abstains is a vote of its own, that it wasn't asked says nothing. vote: rows x labellers of ABSTAIN, GOOD, BAD, NOT_ASKED; weight: how many texts voted like it.
    Starts from the majority of votes; counts are smoothed, so unanimous labellers give no infinite weight. No rows give
    no posteriors."""
    weight = np.ones(len(vote)) if weight is None else weight
    good, bad = (vote == GOOD).sum(axis=1), (vote == BAD).sum(axis=1)
    post = np.clip(np.where(good + bad > 0, (bad + 2 * prior * (bad > 0)) / np.maximum(good * 0.3 + bad, 1), prior), 0.02, 0.98)
    table = np.full((vote.shape[1], 2, 4), 1 / 3)
    table[:, :, NOT_ASKED] = 1  # says nothing
    for _ in range(rounds if len(vote) else 0):
        right, wrong = weight * (1 - post), weight * post
        for j in range(vote.shape[1]):
            asked = vote[:, j] != NOT_ASKED
            for v in (ABSTAIN, GOOD, BAD):
                hit = vote[:, j] == v
                table[j, 0, v] = (right[hit].sum() + 0.5 + (v == GOOD)) / (right[asked].sum() + 2.5)
                table[j, 1, v] = (wrong[hit].sum() + 0.5 + (v == BAD)) / (wrong[asked].sum() + 2.5)
        share = np.clip(wrong.sum() / weight.sum(), 1e-3, 0.5)
        odds = np.log(share / (1 - share)) + sum(np.log(table[j, 1, vote[:, j]] / table[j, 0, vote[:, j]]) for j in range(vote.shape[1]))
        post = 1 / (1 + np.exp(-np.clip(odds, -35, 35)))
    return post, table


def _sure(post: np.ndarray) -> np.ndarray:
    """Posteriors that a scorer is trained on."""
    return (post <= 0.2) | (post >= 0.8)


@dataclass
class Linear:
    """A logistic model in training: weights, bias, and what AdaGrad has summed up for each."""

    weights: np.ndarray
    bias: float
    grown: np.ndarray
    grown_bias: float

    def pack(self) -> np.ndarray:
        return np.concatenate([self.weights, [self.bias], self.grown, [self.grown_bias]])

    @staticmethod
    def unpack(flat: np.ndarray) -> Linear:
        return Linear(flat[:SIZE].copy(), float(flat[SIZE]), flat[SIZE + 1 : 2 * SIZE + 1].copy(), float(flat[-1]))


def train(model: Linear, index: np.ndarray, value: np.ndarray, sizes: np.ndarray, post: np.ndarray, usable: np.ndarray, seed: int, passes: int = PASSES, rate: float = 0.3, sparse: float = 2e-4) -> None:
    """Moves the model by AdaGrad over small batches; features that aren't usable stay at 0, weights are drawn to 0 by
    `sparse`. Rows whose posterior isn't sure, or on which all labellers abstained (given as 0.5), are left out."""
    known = np.flatnonzero(_sure(post))
    first, rng = np.cumsum(sizes) - sizes, np.random.Generator(np.random.PCG64(seed))
    for _ in range(passes):
        rng.shuffle(known)
        for at in range(0, len(known), 64):
            rows = known[at : at + 64]
            n = sizes[rows]
            take = np.repeat(first[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            own, ix, x = np.repeat(np.arange(len(rows)), n), index[take], value[take]
            margin = model.bias + np.bincount(own, weights=model.weights[ix] * x, minlength=len(rows))
            error = 1 / (1 + np.exp(-np.clip(margin, -35, 35))) - post[rows]
            slope = np.bincount(ix, weights=x * error[own], minlength=SIZE) / len(rows)
            slope[~usable] = 0
            moved = np.flatnonzero(slope)
            model.grown[moved] += slope[moved] ** 2
            step = rate / np.sqrt(model.grown[moved])
            new = model.weights[moved] - step * slope[moved]
            model.weights[moved] = np.sign(new) * np.maximum(np.abs(new) - step * sparse, 0)
            model.grown_bias += error.mean() ** 2
            model.bias -= rate * error.mean() / np.sqrt(model.grown_bias)


@dataclass(frozen=True)
class Scorer:
    """Two linear models over the same features, and what the labellers were found to be worth: `accuracies` as estimated,
    `measured` against annotators: (votes that agree, votes) of each labeller on annotated texts of the sample."""

    quality: tuple[np.ndarray, float]
    toxicity: tuple[np.ndarray, float]
    accuracies: dict[str, float]
    measured: dict[str, tuple[int, int]]

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(probability of good quality, probability of toxicity) of each text."""
        index, value, text = features(texts)
        out = []
        for (weights, bias), x in ((self.quality, scaled(index, value, text, len(texts))), (self.toxicity, value)):
            margin = bias + np.bincount(text, weights=weights[index] * x, minlength=len(texts))
            out.append(1 / (1 + np.exp(-np.clip(margin, -35, 35))))
        return 1 - out[0], out[1]


def _sample(docs: DataFrame, labels: DataFrame | None, id_col: str, text_col: str, sample: int) -> DataFrame:
    """id, text, quality, toxic (of annotators; null where they haven't looked) of `sample` rows."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    first = lambda ids, n: ids.orderBy(F.xxhash64("id"), "id").limit(n).distinct()
    chosen = first(rows.select("id"), sample)
    if labels is None:
        return rows.join(F.broadcast(chosen), "id", "left_semi").withColumns({"quality": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    looked = labels.where("quality is not null or toxic is not null").select(F.col("doc_id").alias("id")).distinct()
    sure = first(looked.join(rows.select("id"), "id", "left_semi"), sample // 2).withColumn("sure", F.lit(1))
    both = sure.unionByName(chosen.withColumn("sure", F.lit(0))).groupBy("id").agg(F.max("sure").alias("sure"))
    chosen = both.orderBy(F.desc("sure"), F.xxhash64("id"), "id").limit(sample).select("id")
    known = labels.join(F.broadcast(chosen), labels["doc_id"] == chosen["id"], "left_semi").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    return rows.join(F.broadcast(chosen), "id", "left_semi").join(F.broadcast(known), "id", "left").select("id", "text", "quality", "toxic")


def _measured(seen: list) -> dict[str, tuple[int, int]]:
    """(votes that agree with withheld labels, votes) of each labeller."""
    names = [f"{n}/quality" for n in QUALITY_LABELLERS] + [f"{n}/toxicity" for n in TOXIC_LABELLERS]
    out: dict[str, tuple[int, int]] = {}
    for r in seen:
        for k, name in enumerate(names):
            gold = r.quality if k < len(QUALITY_LABELLERS) else None if r.toxic is None else 1 - r.toxic
            if r.held and gold is not None and r.votes[k] in (GOOD, BAD):
                agree, n = out.get(name, (0, 0))
                out[name] = agree + r.n * ((r.votes[k] == GOOD) == bool(gold)), n + r.n
    return out


def fit(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Scorer:
    """Fits on at most `sample` texts (smallest hashes of the id, of any type): first annotated ones of docs, up to half of
    the sample, then any. labels: doc_id, quality, toxic of annotators, one more labeller; one label in WITHHELD doesn't
    vote, and `measured` rests on those alone. No texts: a scorer that gives one half.

    Features and votes of the sample are a table in the scratch folder. WORKERS tasks train on its parts and their models
    are averaged ROUNDS times, so the driver holds vote patterns and a few models, however long the texts are."""

    fold = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(toxicity.FOLDS)).cast("int")
    held = F.pmod(F.xxhash64("id"), F.lit(WITHHELD)) == 0
    rows = _sample(docs, labels, id_col, text_col, sample).select("text", "quality", "toxic", F.xxhash64("id").alias("order"), held.alias("held"), F.when(F.col("toxic").isNotNull() & ~held, fold).otherwise(-1).alias("fold"))
    texts = written(rows, "sample")
    shared = docs.sparkSession.sparkContext.broadcast(toxicity.counted(texts.where("fold >= 0").select("text", "toxic", "fold")))  # toxicity.UNITS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = {k: shared.value.without(k) for k in range(-1, toxicity.FOLDS)}
        for batch in batches:
            for part in sliced(batch, "text", 1_000_000):
                texts = strings(part.column(0))
                index, value, text = features(texts)
                ends = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
                cut = lambda a: [a[i:j].tobytes() for i, j in zip(ends, ends[1:])]
                held = part.column(4).to_pylist()
                own = lambda c, good: [NOT_ASKED if x is None or h else GOOD if (x == 1) == good else BAD for x, h in zip(part.column(c).to_pylist(), held)]
                voted = [bytes([*a, q, *b, x, y]) for (a, b), q, x, y in zip(map(votes, texts), own(1, True), beginnings(texts, part.column(5).to_pylist(), models), own(2, False))]
                yield pa.RecordBatch.from_arrays([pa.array(cut(index.astype("<i4")), pa.binary()), pa.array(cut(value.astype("<f4")), pa.binary()), pa.array(voted, pa.binary()), *part.columns[1:5]], names=["index", "value", "votes", "quality", "toxic", "order", "held"])

    made = texts.mapInArrow(run, "index binary, value binary, votes binary, quality int, toxic int, `order` bigint, held boolean")
    table = written(made.repartitionById(WORKERS, F.pmod("order", F.lit(WORKERS)).cast("int")).sortWithinPartitions("order", "votes", "index"), "votes")  # a file a worker
    seen = table.groupBy("votes", "quality", "toxic", "held").agg(F.count("*").alias("n")).orderBy("votes").collect()  # patterns of votes
    patterns = sorted({bytes(r.votes) for r in seen})
    vote = np.array([list(p) for p in patterns], np.int8).reshape(len(patterns), len(QUALITY_LABELLERS) + len(TOXIC_LABELLERS))
    weight = np.zeros(len(patterns))
    for r in seen:
        weight[patterns.index(bytes(r.votes))] += r.n
    posts, accuracies, models, at = [], {}, [], 0
    for kind, names, prior in (("quality", QUALITY_LABELLERS, 0.15), ("toxicity", TOXIC_LABELLERS, 0.1)):
        own = vote[:, at : at + len(names)]
        at += len(names)
        voted = np.isin(own, (GOOD, BAD)).any(axis=1)
        post = np.full(len(patterns), 0.5)
        post[voted], found = expectation_maximisation(own[voted], weight[voted], prior=prior)
        posts.append(post)
        sure = _sure(post)
        bias = float(np.log(((weight * post)[sure].sum() + 1) / ((weight * (1 - post))[sure].sum() + 1))) if sure.any() else 0.0
        models.append(Linear(np.zeros(SIZE), bias, np.full(SIZE, 1e-6), 1e-6))
        accuracies |= {f"{n}/{kind}": float((found[j, 0, GOOD] + found[j, 1, BAD]) / (found[j, :, GOOD].sum() + found[j, :, BAD].sum())) for j, n in enumerate(names)}
    if patterns:
        models = _averaged(table, dict(zip(patterns, zip(*(p.tolist() for p in posts)))), models)
    discard(table, texts)
    return Scorer(*((m.weights, m.bias) for m in models), accuracies, _measured(seen))


def _averaged(table: DataFrame, post: dict[bytes, tuple[float, float]], models: list[Linear]) -> list[Linear]:
    """The models after ROUNDS of training on the parts of the sample, which are read as they were written: no round shuffles."""
    dealt = table.select("index", "value", "votes")

    def parts(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        index, value, sizes, posts = [], [], [], []
        for batch in batches:
            for i, v, p in zip(*(batch.column(k).to_pylist() for k in range(3))):
                index.append(np.frombuffer(i, "<i4"))
                value.append(np.frombuffer(v, "<f4"))
                sizes.append(len(i) // 4)
                posts.append(post[p])
        whole = lambda a, kind: np.concatenate(a) if a else np.empty(0, kind)
        return whole(index, np.int32), whole(value, np.float32), np.array(sizes, np.int64), np.array(posts).reshape(-1, 2)

    def support(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"n": [np.bincount(parts(batches)[0], minlength=SIZE).astype("<i8").tobytes()]}, schema=pa.schema([("n", pa.binary())]))

    usable = sum(np.frombuffer(r.n, "<i8") for r in dealt.mapInArrow(support, "n binary").collect()) >= SUPPORT
    context = table.sparkSession.sparkContext
    for turn in range(ROUNDS):
        shared = context.broadcast((usable, [m.pack() for m in models]))  # four numbers a feature

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn, shared=shared) -> Iterator[pa.RecordBatch]:
            index, value, sizes, posts = parts(batches)
            text = np.repeat(np.arange(len(sizes)), sizes)
            for k, flat in enumerate(shared.value[1]):
                model = Linear.unpack(flat)
                train(model, index, scaled(index, value, text, len(sizes)) if k == 0 else value, sizes, posts[:, k], shared.value[0], turn)
                sure = int(_sure(posts[:, k]).sum())
                yield pa.RecordBatch.from_pydict({"k": [k], "n": [sure], "flat": [model.pack().tobytes()]}, schema=pa.schema([("k", pa.int32()), ("n", pa.int64()), ("flat", pa.binary())]))

        found = dealt.mapInArrow(run, "k int, n bigint, flat binary").where("n > 0").collect()  # two models a worker
        for k in range(len(models)):
            own = [(r.n, np.frombuffer(r.flat)) for r in found if r.k == k]
            if own:
                models[k] = Linear.unpack(sum(n * flat for n, flat in own) / sum(n for n, _ in own))
        shared.destroy()
    return models


def classify(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, `keep`, quality (0 to 1), toxicity (0 to 1) and kept (quality of POOR at least, toxicity below TOXIC).

    Null texts are scored as empty ones; texts of any length are scored whole; repeated rows get equal rows; an empty
    table gives no rows; only `keep`, id and text are read, and nothing is shuffled. A column of `keep` that has the
    name of a result gives way to it.
    """
    keep = tuple(c for c in keep if c not in ("id", "quality", "toxicity", "kept"))
    source = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # SIZE floats, twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "_text", 1_000_000):
                quality, toxicity = shared.value.score(strings(part.column(part.num_columns - 1)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(quality), pa.array(toxicity), pa.array((quality >= POOR) & (toxicity < TOXIC))], names=[*part.schema.names[:-1], "quality", "toxicity", "kept"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "_text")
    return source.mapInArrow(run, schema + ", quality double, toxicity double, kept boolean")
