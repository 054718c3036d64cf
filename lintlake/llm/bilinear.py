"""Language-model scoring with a log-bilinear model over words.

The vectors of the two words before a token, each from the table of its position, add up to a prediction; its products
with the vectors of all listed words, of the end of text and of one class for all rarer words, plus their biases, are
the logits. Within the class of rarer words a word has its share of their counts. The model is trained in
numpy by noise-contrastive estimation on every token of every training document: documents are dealt to the rounds by a hash, so
the number of updates grows with the corpus. Tokens are dealt to shards by a hash of their document, and the number of shards follows
from the table alone: each shard starts a round from the same vectors and trains on its own tokens in the order of
their hashes; changes are merged row by row in a shuffle, in the order of the shards. So neither files nor tasks change a score, and the
driver holds no more than the bounded tables. As logits are sums of a part for each
position, batched matrix products over the whole vocabulary give the normaliser of every pair of context classes exactly.
Token counts cover all training documents. Words among the `listed` most frequent are scored inside map tasks;
all rarer ones meet their counts in a shuffle join, so no vocabulary is broadcast that grows with the corpus.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.shared import dropped, in_small_batches, written

_FLUSH = 400_000
_BLOCK = 512
_AT_ONCE = 1 << 20  # bytes of the texts that are numbered, or deflated ones of those that are scored, at once
_MOST = 3.0  # bound of a vector's components, under which no normaliser overflows


@dataclass(frozen=True)
class ModelRules:
    """`listed` words have vectors of their own as targets and the first `own` of them as contexts; other contexts are
    classed by their last two bytes, the `endings` most frequent of which have vectors. A change counts in full up to `votes`
    updates of a row in all shards and is averaged beyond that. Documents are dealt to `every` shares, at most as many as there are
    `rounds`, which take them in turn, so that each token is trained on. A shard has about `shard` tokens in a round."""

    listed: int = 65_536
    own: int = 1024
    endings: int = 62
    width: int = 32
    every: int = 3
    rounds: int = 3
    shard: int = 2_500_000
    batch: int = 1024
    noise: int = 128
    rate: float = 0.1
    votes: float = 10.0

    def __post_init__(self):
        if not 0 < self.every <= self.rounds:
            raise ValueError(f"{self.rounds} rounds can't train on {self.every} shares of the documents")


@dataclass
class Model:
    """Words and their ids; the ids after the listed words are the end of text and the class of rarer words."""

    names: dict[bytes, int]
    context_of: np.ndarray
    endings: dict[bytes, int]
    counts: np.ndarray
    rare_size: float
    far: np.ndarray
    near: np.ndarray
    word: np.ndarray
    log_norm: np.ndarray | None = None

    @property
    def end(self) -> int:
        return len(self.names)

    def numbered(self, words: list[bytes]) -> np.ndarray:
        """The number of each word of whole documents, in which an empty one stands for an end; one of the class of rarer words is numbered from that class on by its context class."""
        at = np.fromiter(map(self.names.get, words, repeat(-1)), np.int64, len(words))
        for k in np.flatnonzero(at < 0).tolist():
            at[k] = self.end + 1 + self.endings.get(words[k][-2:], len(self.far) - 2) if words[k] else self.end
        return at

    def encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(context before last, last context, target id) of each word and then of the end; a text starts after two ends."""
        return tuple(in_context(self, self.numbered([*words, b""])))

    def normalised(self) -> Model:
        """The model with the log of the normaliser of every two context classes, by products over blocks of words."""
        total = np.zeros((len(self.far), len(self.near)))
        for k in range(0, len(self.word), 4096):
            word, bias = self.word[k : k + 4096, :-1].astype(float), self.word[k : k + 4096, -1].astype(float)
            total += np.exp(self.far @ word.T) @ np.exp(self.near @ word.T + bias).T
        return replace(self, log_norm=np.log(total))

    def log10(self, far: np.ndarray, near: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log10 probability of each target after its context; that of a rarer word is its class's."""
        out = np.empty(len(target))
        before, last = self.far.astype(float), self.near.astype(float)
        for k in range(0, len(target), 1 << 14):  # of a very long text only so many vectors at once
            part = slice(k, k + (1 << 14))
            word, context = self.word.take(target[part], axis=0), before.take(far[part], axis=0)
            context += last.take(near[part], axis=0)
            out[part] = np.einsum("ij,ij->i", context, word[:, :-1].astype(float)) + word[:, -1] - self.log_norm[far[part], near[part]]
        return out / np.log(10)


def held_out() -> Column:
    """Documents that training leaves out: crc32 of the id as text leaves 2 when divided by 7."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _texts(docs: DataFrame, *columns: Column) -> DataFrame:
    return docs.select(*columns, F.coalesce("text", F.lit("")).cast("binary").alias("_raw"))


def _batch_words(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts of a batch, each text's followed by an empty one for its end, and how many those are by text."""
    words: list[bytes] = []
    pasts = [0]
    for raw in batch["_raw"].to_pylist():
        words += raw.lower().split()
        words.append(b"")
        pasts.append(len(words))
    return words, np.diff(pasts)


def _deflated(raw: bytes) -> bytes:
    small = zlib.compressobj(1, wbits=12, memLevel=4)  # the tables that zlib clears for each text are no longer than most texts
    return small.compress(raw) + small.flush()


def _split(items: list, cuts: np.ndarray) -> list[list]:
    edges = [0, *cuts.tolist(), len(items)]
    return [items[low:past] for low, past in zip(edges, edges[1:], strict=False)]


def token_counts(train: DataFrame) -> DataFrame:
    """word (binary; empty: the end of text), c: how often each token occurs, added up in each task first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for raw in batch["_raw"].to_pylist():
                own.update(raw.lower().split())
                own[b""] += 1
            if len(own) > _FLUSH:
                yield out()
                own.clear()
        yield out()

    return _texts(train).mapInArrow(counted, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


def _most_frequent(counts: DataFrame, most: int) -> list:
    """At most `most` words by falling count: those over a count that a histogram of counts gives."""
    size = F.floor(F.log2("c") * 64)
    seen, cut = 0, None
    for row in sorted(counts.groupBy(size.alias("size")).count().collect(), key=lambda r: -r["size"]):  # under 64 * 64 rows
        seen += row["count"]
        if seen > most:
            break
        cut = row["size"]
    found = counts.filter(size >= cut).collect() if cut is not None else []
    return sorted(found, key=lambda r: (-r["c"], bytes(r["word"])))


def listed_model(counts: DataFrame, rules: ModelRules) -> Model:
    """The words, and vectors before training. The biases are those of the counts."""
    top = _most_frequent(counts.filter("length(word) > 0"), rules.listed)
    total, kinds, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.length("word") == 0, F.col("c"))), F.lit(0))).first()
    rare, rare_kinds = total - ends - sum(r["c"] for r in top), kinds - len(top) - (ends > 0)
    words, n = [bytes(r["word"]) for r in top], np.array([*(r["c"] for r in top), ends, rare], float)
    common: Counter[bytes] = Counter()
    for word, c in zip(words[rules.own :], n[rules.own :], strict=False):
        common[word[-2:]] += int(c)
    own = min(rules.own, len(words))
    endings = {e: own + k for k, (e, _) in enumerate(sorted(common.items(), key=lambda x: (-x[1], x[0]))[: rules.endings])}
    contexts = own + len(endings) + 2  # then the other words and the end
    context_of = np.array([k if k < own else endings.get(w[-2:], contexts - 2) for k, w in enumerate(words)] + [contexts - 2], np.int64)
    rng = np.random.default_rng(5)
    far, near = (rng.normal(0, 0.3, (contexts, rules.width)).astype(np.float32) for _ in range(2))
    word = np.zeros((len(n), rules.width + 1), np.float32)
    word[:, -1] = np.log((n + 1) / (n + 1).sum())
    return Model({w: k for k, w in enumerate(words)}, context_of, endings, n, float(rare + rare_kinds + 1), far, near, word)


def training_tokens(train: DataFrame, model: Model, rules: ModelRules, shards: int) -> DataFrame:
    """doc_id, held_out, shard, key, share, ids (binary, deflated uint32), words, times, row (another in each run, so write the result).

    `share` is that of the rounds that a document falls to, `ids` are the numbers of all its tokens and the end (`Model.numbered`), `words`
    its distinct words of the class of rarer words and `times` how often each stands in it. Equal documents of one id have equal rows.
    """

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_small_batches(batches, most=_AT_ONCE):
            words, sizes = _batch_words(batch)
            numbers, pasts = model.numbered(words), np.cumsum(sizes)
            away = np.flatnonzero(numbers > model.end)
            rare = [Counter(x) for x in _split([words[k] for k in away.tolist()], np.searchsorted(away, pasts[:-1]))]
            rows = [_deflated(x.tobytes()) for x in np.split(numbers.astype("<u4"), pasts[:-1])]
            columns = [pa.array(rows, pa.binary()), pa.array([list(x) for x in rare], pa.list_(pa.binary())), pa.array([list(x.values()) for x in rare], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], "ids", "words", "times"])

    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    share = F.pmod(F.xxhash64(key), F.lit(rules.every)).cast("int")
    dealt = [F.pmod(key, F.lit(shards)).cast("int").alias("shard"), key.alias("key"), share.alias("share")]
    texts = _texts(train, F.col("doc_id").cast("bigint"), held_out().alias("held_out"), *dealt)
    shape = "doc_id bigint, held_out boolean, shard int, key bigint, share int, ids binary, words array<binary>, times array<bigint>"
    return texts.mapInArrow(taken, shape).withColumn("row", F.monotonically_increasing_id())


def in_context(model: Model, ids: np.ndarray) -> np.ndarray:
    """Rows context before last, last context and target of the tokens of whole documents, as `training_tokens` numbers them."""
    end, ends = len(model.word) - 2, len(model.far) - 1
    context = np.concatenate([model.context_of[:-1], [ends], np.arange(ends)]).astype(np.int32)[ids]
    near = np.concatenate([np.full(1, ends, np.int32), context[:-1]])
    far = np.where(near == ends, ends, np.concatenate([near[:1], near[:-1]]))  # nothing of the document before
    return np.stack([far, near, np.minimum(ids, end + 1)]).astype(np.int32)


@dataclass
class _Rows:
    """A table of vectors, and how often each row was updated."""

    values: np.ndarray
    times: np.ndarray


def _summed(gradients: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows in order, how often each occurs, and the sums of the gradients of each, added in their order.

    Of 64-bit numbers a sort also gives the order. Rows that occur once aren't added up, and sums take two columns at once, as complex numbers.
    """
    bits = len(rows).bit_length()
    ranked = np.sort((rows << bits) | np.arange(len(rows)))
    order, ranked = ranked & ((1 << bits) - 1), ranked >> bits
    at = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    times = np.diff(at, append=len(ranked))
    total = gradients.take(order[at], axis=0)
    many = np.flatnonzero(times > 1)
    if len(many):
        own = gradients.take(order[np.repeat(times > 1, times)], axis=0).view(np.complex64)
        total[many] = np.add.reduceat(own, np.cumsum(times[many]) - times[many], axis=0).view(np.float32)
    return ranked[at], times, total


def noise_contrastive(model: Model, ids: np.ndarray, rules: ModelRules, rate: float, seed: int) -> list[_Rows]:
    """Far, near and word rows after one pass over the columns of `ids`, in an order that the seed gives.

    Each batch shares `noise` words drawn by their counts; a batch's true words are told from them by their logits, taken as
    normalised, less the log of the expected number of such noise words. Rows are updated with Adagrad. The three tables are one, with
    zeros up to an even number of columns, so that a batch is one update.
    """
    rng, share = np.random.default_rng(seed), (model.counts + 1) / (model.counts + 1).sum()
    cumulative, log_noise = np.cumsum(share) / share.sum(), np.log(rules.noise * share).astype(np.float32)
    starts, bias = np.cumsum([0, len(model.far), len(model.near), len(model.word)]), model.far.shape[1]
    values = np.zeros((starts[-1], bias + 2 - bias % 2), np.float32)
    for low, table in zip(starts, (model.far, model.near, model.word), strict=False):
        values[low : low + len(table), : table.shape[1]] = table
    sums, times = np.ones(values.shape, np.float32), np.zeros(len(values), np.float32)
    columns = ids.T[rng.permutation(ids.shape[1])]
    columns += starts[:3].astype(columns.dtype)
    drawn = np.searchsorted(cumulative, rng.random((-(-len(columns) // rules.batch), rules.noise)))
    for k, wrong in zip(range(0, len(columns), rules.batch), np.minimum(drawn, len(share) - 1), strict=True):
        a, b, true = columns[k : k + rules.batch].T
        guess = values.take(a, axis=0)
        guess += values.take(b, axis=0)
        guess[:, bias] = 1
        true_rows, wrong_rows = values.take(true, axis=0), values.take(wrong + starts[2], axis=0)
        away = wrong_rows.copy()
        away[:, bias] -= log_noise[wrong]
        with np.errstate(over="ignore"):  # of a large logit: 1 / (1 + inf)
            true_error = -1 / (1 + np.exp(np.einsum("ij,ij->i", guess, true_rows) - log_noise[true - starts[2]]))
            wrong_error = guess @ np.negative(away, out=away).T
            np.exp(wrong_error, out=wrong_error)
        wrong_error += 1
        np.reciprocal(wrong_error, out=wrong_error)
        back = wrong_error @ wrong_rows
        true_rows *= true_error[:, None]
        back += true_rows
        back[:, bias:] = 0
        toward = wrong_error.T @ guess
        guess *= true_error[:, None]
        own, often, g = _summed(np.concatenate([back, back, guess, toward]), np.concatenate([a, b, true, wrong + starts[2]]).astype(np.int64))
        seen = sums.take(own, axis=0)
        seen += g * g
        sums[own] = seen
        times[own] += often
        g *= rate
        g /= np.sqrt(seen, out=seen)
        values[own] -= g
    cuts = [slice(low, past) for low, past in zip(starts, starts[1:], strict=False)]
    return [_Rows(values[x, : table.shape[1]], times[x]) for x, table in zip(cuts, (model.far, model.near, model.word), strict=True)]


def _changes(model, rules: ModelRules, rate: float, seed: int):
    """Trains on the shards of a task, which come in order; gives rows (block, shard, rows, votes and changes as bytes) of what each changed.

    A shard that is much larger than others, as one very frequent document makes it, is trained on in parts.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        shard, part, held, size = -1, 0, [], 0
        for batch in batches:
            for own, raw in zip(batch["shard"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if held and (own != shard or size > 2 * rules.shard):
                    yield (shard << 20) + part, in_context(model.value, np.concatenate(held))
                    part, held, size = part + 1 if own == shard else 0, [], 0
                shard = own
                held.append(np.frombuffer(zlib.decompress(raw), "<u4"))
                size += len(held[-1])
        if held:
            yield (shard << 20) + part, in_context(model.value, np.concatenate(held))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = model.value
        for shard, ids in pieces(batches):
            first = 0
            for was, now in zip((start.far, start.near, start.word), noise_contrastive(start, ids, rules, rate, seed + zlib.crc32(ids.tobytes())), strict=True):
                rows = np.flatnonzero(now.times)
                change = np.zeros((len(rows), rules.width + 1), "<f4")
                change[:, : was.shape[1]] = now.values[rows] - was[rows]
                votes = np.minimum(1, now.times[rows] / rules.votes).astype("<f4")
                rows, first = rows + first, first + len(was)
                cuts = np.flatnonzero(np.diff(rows // _BLOCK)) + 1
                for own, v, c in zip(np.split(rows, cuts), np.split(votes, cuts), np.split(change, cuts), strict=True):
                    if len(own):
                        payload = [pa.array([x.tobytes()], pa.binary()) for x in ((own % _BLOCK).astype("<i4"), v, c)]
                        yield pa.RecordBatch.from_arrays([pa.array([own[0] // _BLOCK], pa.int32()), pa.array([shard], pa.int64()), *payload], ["block", "shard", "rows", "votes", "change"])

    return train


def _merged(width: int):
    """Adds up the changes of the blocks of a task in the order of their shards, and divides each row's by its votes where they exceed one."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, rows, votes, change in zip(*(batch[c].to_pylist() for c in ("block", "rows", "votes", "change")), strict=True):
                total, seen = blocks.setdefault(block, (np.zeros((_BLOCK, width + 1)), np.zeros(_BLOCK)))
                own = np.frombuffer(rows, "<i4")
                total[own] += np.frombuffer(change, "<f4").reshape(len(own), -1)
                seen[own] += np.frombuffer(votes, "<f4")
        done = [(total / np.maximum(1, seen)[:, None]).astype("<f4").tobytes() for total, seen in blocks.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array(done, pa.binary())], ["block", "change"])

    return merge


def _shards(model: Model, rules: ModelRules) -> int:
    return max(1, -(-int(model.counts.sum()) // (rules.every * rules.shard)))


def fitted(train: DataFrame, counts: DataFrame, rules: ModelRules) -> Model:
    """The model trained on the documents of `train`, whose tokens `counts` counts."""
    model = listed_model(counts, rules)
    tokens = written(training_tokens(train, model, rules, _shards(model, rules)), "training")
    model = trained(model, tokens, rules)
    dropped(tokens)
    return model


def trained(model: Model, tokens: DataFrame, rules: ModelRules) -> Model:
    """The trained model. Rounds differ in their rate and tokens; what a shard draws follows from its own tokens."""
    context, shards = tokens.sparkSession.sparkContext, _shards(model, rules)
    tasks = min(shards, 4096)
    sizes = np.cumsum([len(model.far), len(model.near)])
    for k in range(rules.rounds):
        shared = context.broadcast(replace(model, names={}))
        dealt = tokens.filter(F.col("share") == k % rules.every).select("shard", "key", "ids").repartition(tasks, "shard").sortWithinPartitions("shard", "key", "ids")
        changes = dealt.mapInArrow(_changes(shared, rules, rules.rate * (1 - k / rules.rounds), k), "block int, shard bigint, rows binary, votes binary, change binary")
        merged = changes.repartition("block").sortWithinPartitions("block", "shard").mapInArrow(_merged(rules.width), "block int, change binary").collect()  # at most all rows of the model
        whole = np.zeros((-(-(sizes[1] + len(model.word)) // _BLOCK) * _BLOCK, rules.width + 1), np.float32)
        for r in merged:
            whole[r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] = np.frombuffer(r["change"], "<f4").reshape(_BLOCK, -1)
        far, near, word = np.split(whole, sizes)
        word = model.word + word[: len(model.word)]
        word[:, :-1] = np.clip(word[:, :-1], -_MOST, _MOST)
        model = replace(model, far=np.clip(model.far + far[:, :-1], -_MOST, _MOST), near=np.clip(model.near + near[:, :-1], -_MOST, _MOST), word=word)
        shared.unpersist()
    return model.normalised()


def scored_with(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """`scored` under a fitted model and its counts."""
    return scores_of(written(training_tokens(docs, model, ModelRules(), 1), "training"), counts, model)


def scores_of(tokens: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """The scores of the written documents of `training_tokens`, under a fitted model and its counts."""
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    shared = tokens.sparkSession.sparkContext.broadcast(replace(model, names={}))
    end = model.end

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        log_counts = np.log10(np.append(own.counts[:-1] + 1, 1.0))  # of the class of rarer words: added from the join
        for batch in in_small_batches(batches, "ids", _AT_ONCE):
            ids = [np.frombuffer(zlib.decompress(x), "<u4") for x in batch["ids"].to_pylist()]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            far, near, target = in_context(own, np.concatenate(ids))
            starts = np.cumsum(sizes) - sizes
            rare = np.add.reduceat((target == end + 1).astype(np.int64), starts)
            score = np.add.reduceat(own.log10(far, near, target), starts) - rare * np.log10(own.rare_size)
            columns = [sizes, sizes - 1 - rare, np.add.reduceat(log_counts[target], starts), score]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, columns)], ["row", "doc_id", "held_out", "n_tokens", "listed", "logs", "model"])

    shape = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, listed bigint, logs double, model double"
    local = written(tokens.select("row", "doc_id", "held_out", "ids").mapInArrow(score, shape), "scores")
    rare = tokens.select("row", F.inline(F.arrays_zip("words", "times"))).withColumnRenamed("words", "word")
    met = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("met"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"))
    out = local.join(met, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    known_end = F.lit(int(model.counts[-2] > 0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("listed") + F.coalesce("met", F.lit(0)) + known_end).cast("bigint").alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.log10(F.lit(float(total + kinds + 1)))).alias("base_score"), (F.col("model") + more).alias("score"),
    )


def scored(docs: DataFrame, rules: ModelRules = ModelRules()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of `docs`.

    A null or empty text is one token, the end. Repeated rows each get a row and, in training, count each; a null
    doc_id counts as an empty one for `held_out`; an empty table gives an empty one; without a training document
    every count is zero and the model untrained. Further columns are ignored. Scores follow from the rows alone, however
    they are partitioned.
    """
    train = docs.filter(~held_out())
    counts = written(token_counts(train), "tokens")
    model = listed_model(counts, rules)
    tokens = written(training_tokens(docs, model, rules, _shards(model, rules)), "training")
    return scores_of(tokens, counts, trained(model, tokens.filter(~F.col("held_out")), rules))
