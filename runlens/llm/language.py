"""Language identification by interpolated Kneser-Ney character models kept in sorted hash arrays."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import fold, ship, stored

ORDER = 4
UNKNOWN = "und"
FOLDS = 5  # calibration rows are scored by models without their own fold


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])


def grams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all ORDER-grams of texts laid end to end, and how many each text has.

    Letters are lower-cased, each run of other characters is one space, and a text starts after ORDER - 1 spaces.
    A key packs 16 bits of each character, the oldest first, so its low bits are the shorter grams; letters beyond 16 bits
    are hashed into values that no letter below has (surrogates and private use), so they never look like one of those.
    """
    pad = " " * (ORDER - 1)
    text = pad + pad.join(texts)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) if t.isascii() else len(t.lower()) for t in texts], np.int64)
    begins = np.cumsum(lengths + ORDER - 1) - lengths
    letter = _letters()[codes]
    codes = np.where(letter, np.where(codes > 0xFFFF, 0xD800 + codes % 8448, codes), 32).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    inside = np.ones(len(codes), bool)
    for k in range(1, ORDER):
        inside[begins - k] = False
    keep[begins[begins < len(keep)]] |= True
    keep |= ~inside
    codes, inside = codes[keep], inside[keep]
    key = codes[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        key |= codes[ORDER - 1 - k : len(codes) - k] << np.uint64(16 * k)
    key = key[inside[ORDER - 1 :]]
    owner = np.cumsum(keep)
    edges = np.append(begins, len(keep) + ORDER - 1)
    done = np.append(0, owner)
    many = [done[min(b, len(keep))] for b in edges]
    return key, np.array([many[i + 1] - many[i] - (ORDER - 1 if i + 1 < len(texts) else 0) for i in range(len(texts))], np.int64)


def _low(key: np.ndarray, n: int) -> np.ndarray:
    return key & np.uint64((1 << (16 * n)) - 1)


@dataclass
class Model:
    """Per order: sorted keys with a probability for each language, and sorted contexts with what they leave to the next order."""

    langs: list[str]
    keys: list[np.ndarray]
    probs: list[np.ndarray]
    contexts: list[np.ndarray]
    gammas: list[np.ndarray]
    floor: float = 1.0
    kappa: float = 1.0
    limits: np.ndarray | None = None  # per language: mean, spread between texts, spread within a text, of bits a character

    def _find(self, table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, key), max(len(table) - 1, 0))
        return at, (table[at] == key) if len(table) else np.zeros(len(key), bool)

    def prob(self, key: np.ndarray, n: int = ORDER) -> np.ndarray:
        """Probability of each key's last character after the n - 1 before it, for each language."""
        if n == 0:
            return np.full((len(key), len(self.langs)), self.floor)
        key = _low(key, n)
        at, hit = self._find(self.keys[n], key)
        out = np.empty((len(key), len(self.langs)))
        out[hit] = self.probs[n][at[hit]]
        if not hit.all():
            rest = key[~hit]
            c, known = self._find(self.contexts[n], rest >> np.uint64(16))
            gamma = np.ones((len(rest), len(self.langs)))
            gamma[known] = self.gammas[n][c[known]]
            out[~hit] = gamma * self.prob(rest, n - 1)
        return out

    def bits(self, key: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text in each language, and the sum of squares of its bits a character in its best one."""
        at, hit = self._find(self.keys[ORDER], key)
        each = np.empty((len(key), len(self.langs)), np.float32)
        each[hit] = self.logs[at[hit]]
        if not hit.all():
            own, back = np.unique(key[~hit], return_inverse=True)
            each[~hit] = -np.log2(self.prob(own))[back]
        out = np.zeros((len(counts), len(self.langs)))
        some = np.flatnonzero(counts)
        if len(some):
            first = (np.cumsum(counts) - counts)[some]
            out[some] = np.add.reduceat(each.astype(np.float64), first, axis=0)
        return out, each

    def ready(self) -> Model:
        self.logs = -np.log2(self.probs[ORDER]).astype(np.float32)
        return self


def kneser_ney(langs: Sequence[str], rows: Sequence[tuple[np.ndarray, np.ndarray]]) -> Model:
    """Interpolated Kneser-Ney models from the ORDER-gram counts of each language: raw counts at the highest order,
    below it the number of different characters that come before; one discount a language and order, n1 / (n1 + 2 n2)."""
    per: list[list[tuple[np.ndarray, np.ndarray]]] = [[(k, c.astype(float)) for k, c in rows]]
    for n in range(ORDER - 1, 0, -1):
        nxt = []
        for k, _ in per[-1]:
            u, c = np.unique(_low(k, n), return_counts=True)
            nxt.append((u, c.astype(float)))
        per.append(nxt)
    per = per[::-1]  # per[n - 1]: order n
    letters = len(np.unique(np.concatenate([k for k, _ in per[0]]))) if rows else 0
    m = Model(list(langs), [np.zeros(0, np.uint64)], [np.zeros((0, 0))], [np.zeros(0, np.uint64)], [np.zeros((0, 0))], floor=1 / (letters + 1))
    for n in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([k for k, _ in per[n - 1]]))
        ctx = np.unique(keys >> np.uint64(16))
        gammas, first = np.ones((len(ctx), len(langs))), np.zeros((len(keys), len(langs)))
        of = np.searchsorted(ctx, keys >> np.uint64(16))
        for j, (k, c) in enumerate(per[n - 1]):
            if not len(k):
                continue
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            d = min(0.95, max(0.1, n1 / max(n1 + 2 * n2, 1)))
            at = np.searchsorted(ctx, k >> np.uint64(16))
            total, kinds = np.bincount(at, c, len(ctx)), np.bincount(at, minlength=len(ctx))
            gammas[:, j] = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            first[np.searchsorted(keys, k), j] = (c - d) / total[at]
        m.contexts.append(ctx)
        m.gammas.append(gammas)
        m.keys.append(np.zeros(0, np.uint64))
        m.probs.append(np.zeros((0, len(langs))))
        lower = m.prob(keys, n - 1)
        m.keys[n], m.probs[n] = keys, first + gammas[of] * lower
    return m.ready()


def count_grams(labelled: DataFrame) -> DataFrame:
    """(lang, key, n) of all texts of (lang, text); each task adds up what it has read before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def fold_in(lang: str) -> tuple[np.ndarray, np.ndarray]:
            keys, counts = (np.concatenate(x) for x in zip(*held[lang]))
            u, back = np.unique(keys, return_inverse=True)
            held[lang] = [(u, np.bincount(back, counts, len(u)).astype(np.int64))]
            return held[lang][0]

        for b in batches:
            by: dict[str, list[str]] = {}
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t:
                    by.setdefault(lang, []).append(t)
            for lang, texts in by.items():
                for part in _portions(texts):
                    u, c = np.unique(grams([texts[k] for k in part])[0], return_counts=True)
                    held.setdefault(lang, []).append((u, c))
                    if sum(len(k) for k, _ in held[lang]) > 2_000_000:
                        fold_in(lang)
        for lang in held:
            u, c = fold_in(lang)
            for a in range(0, len(u), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(u[a : a + 50_000])), pa.array(u[a : a + 50_000].view(np.int64)), pa.array(c[a : a + 50_000])], names=["lang", "key", "n"])

    return labelled.select("lang", "text").mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _portions(texts: Sequence[str], chars: int = 1 << 18) -> Iterator[list[int]]:
    part, size = [], 0
    for k, t in enumerate(texts):
        part.append(k)
        size += len(t)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def _scored(m: Model, column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """(places, bits, characters, has letters, squares) of portions of a column of texts; memory follows a portion."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // (1 << 18), prepend=0))  # texts that reach the next portion
    for places in np.split(np.arange(len(sizes)), cuts):
        if not len(places):
            continue
        texts = [x or "" for x in column.slice(int(places[0]), len(places)).to_pylist()]
        letters = np.array([any(map(str.isalpha, t)) for t in texts], bool)
        bits, counts, squares = np.zeros((len(texts), len(m.langs))), np.zeros(len(texts), np.int64), np.zeros(len(texts))
        part = np.flatnonzero(letters)
        if len(part):
            key, n = grams([texts[k] for k in part.tolist()])
            got, each = m.bits(key, n)
            bits[part], counts[part] = got, n
            sq = each[np.arange(len(each)), np.repeat(got.argmin(axis=1), n)].astype(np.float64) ** 2
            squares[part] = np.add.reduceat(sq, np.cumsum(n) - n) if len(sq) else 0
        yield places, bits, counts, letters, squares


def _measured(docs: DataFrame, model: Model, schema: str, give) -> DataFrame:
    """Runs give(model, batch, bits, counts, has letters) over (id, text, ...) batches with the model broadcast."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for places, bits, counts, letters, _ in _scored(sent.value, b.column(1)):
                yield give(sent.value, b.slice(int(places[0]), len(places)), bits, counts, letters)

    return docs.mapInArrow(run, schema)


@dataclass
class Counts:
    """ORDER-gram counts of the sample by fold and language."""

    langs: list[str]
    of: np.ndarray  # fold and language of each entry: fold * len(langs) + place of the language
    key: np.ndarray
    n: np.ndarray

    def rows(self, without: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Keys and counts of each language, in all folds or all but one."""
        out = []
        for j in range(len(self.langs)):
            use = self.of % len(self.langs) == j
            if without is not None:
                use &= self.of // len(self.langs) != without
            u, back = np.unique(self.key[use], return_inverse=True)
            out.append((u, np.bincount(back, self.n[use], len(u))))
        return out


def _out_of_sample(tested: DataFrame, counts: Counts) -> list:
    """(lang, bits, n, squares) of (fold, text, lang), each scored by the models that lack its fold, in one job of a task a fold.
    Rows of a language that has text in one fold alone are left out: nothing is known of them out of sample."""
    sent = tested.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, model, learned = None, None, set()
        for b in batches:
            folds = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(folds)) + 1).tolist(), len(folds)]
            for x, y in zip(edges, edges[1:]):
                if x == y:
                    continue
                if at != folds[x]:
                    at = folds[x]
                    rows = sent.value.rows(int(at))
                    model, learned = kneser_ney(sent.value.langs, rows), {c for c, (k, _) in zip(sent.value.langs, rows) if len(k)}
                part = b.slice(x, y - x)
                for places, bits, n, _, squares in _scored(model, part.column(1)):
                    langs = part.column(2).slice(int(places[0]), len(places))
                    use = np.array([c in learned for c in langs.to_pylist()], bool) & (n > 0)
                    yield pa.RecordBatch.from_arrays([langs, pa.array(bits.tolist(), pa.list_(pa.float64())), pa.array(n), pa.array(squares)], names=["lang", "bits", "n", "squares"]).filter(pa.array(use))

    rows = tested.repartition(FOLDS, "fold").sortWithinPartitions("fold").select("fold", "text", "lang")
    return rows.mapInArrow(run, "lang string, bits array<double>, n long, squares double").collect()


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train_docs: int, calibration_docs: int) -> Model:
    """Models of all languages, fitted on a bounded sample of each language's labelled rows that are not held out.

    train_docs: about so many rows of each language (all of a language that has no more, else those whose hashes are in
    its share) are learned, whole texts; so the model that is broadcast follows the languages and this number, not the
    input. About calibration_docs of them fit the score's sharpness and the limits of rejection (see `calibrate`), each
    scored by models without the row's fold.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & (fold(id_col, 5) != 0)).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    have = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not have:
        return Model([], [], [], [], [])
    shares = docs.sparkSession.createDataFrame([(x, min(1.0, train_docs / n), min(1.0, calibration_docs / n)) for x, n in have.items()], "lang string, share double, tested double")
    chance = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40)) / float(1 << 40)
    part = F.pmod(F.xxhash64("text", "id"), F.lit(FOLDS)).cast("int")
    sample = labelled.join(F.broadcast(shares), "lang").where(chance < F.col("share")).select("text", "lang", part.alias("fold"), (chance < F.col("tested")).alias("tested"))
    sample = stored(sample, "lang-sample")
    name = F.concat_ws("/", F.col("fold").cast("string"), F.col("lang"))  # folds are counted apart, in one pass
    table = count_grams(sample.select(name.alias("lang"), "text")).toArrow()
    of = table["lang"].combine_chunks().dictionary_encode()
    names = [x.split("/", 1) for x in of.dictionary.to_pylist()]
    langs = sorted({x for _, x in names})  # a language whose texts are all null or empty is not learned
    if not langs:
        return Model([], [], [], [], [])
    place = np.array([int(f) * len(langs) + langs.index(x) for f, x in names])
    counts = Counts(langs, place[of.indices.to_numpy()], table["key"].to_numpy().view(np.uint64), table["n"].to_numpy())
    del table
    got = _out_of_sample(sample.where("tested"), counts)
    return calibrate(kneser_ney(langs, counts.rows()), got)


def calibrate(model: Model, got: Sequence) -> Model:
    """Fits the score's sharpness and the limits of rejection on rows (lang, bits, n, squares) that the model has not learned.

    A language's mean and spreads come from its own rows, those it wins; its spread between texts is not below that of
    all languages' texts around their own means, and is widened as its mean rests on few rows. A language that wins
    none, as one of a single row, accepts whatever is not worse than chance.
    """
    langs = model.langs
    model.limits = np.tile([[np.log2(1 / model.floor), 0.0, 0.0]], (len(langs), 1))
    if got:
        bits, n = np.array([r["bits"] for r in got]), np.array([r["n"] for r in got])
        true, sq = np.array([langs.index(r["lang"]) for r in got]), np.array([r["squares"] for r in got])
        grid = (0.01, 0.03, 0.1, 0.3, 1.0)

        def loss(kappa: float) -> float:
            p = posterior(bits, kappa)
            return -np.log(np.maximum(p[np.arange(len(true)), true], 1e-6)).mean()

        model.kappa = min(grid, key=loss)
        won = true == bits.argmin(axis=1)
        for j in range(len(langs)):
            own = won & (true == j)
            if own.any():
                ce = bits[own, j] / n[own]
                within = np.sqrt(np.maximum(0, (sq[own].sum() / n[own].sum()) - (bits[own, j].sum() / n[own].sum()) ** 2))
                model.limits[j] = [bits[own, j].sum() / n[own].sum(), ce[n[own] >= 200].std() if (n[own] >= 200).any() else 0.0, within]
        long = won & (n >= 200)
        pooled = np.sqrt(((bits[long, true[long]] / n[long] - model.limits[true[long], 0]) ** 2).mean()) if long.any() else 0.0
        of = np.bincount(true[won], minlength=len(langs))
        some = of > 0
        model.limits[some, 1] = np.maximum(model.limits[some, 1], pooled) * np.sqrt(1 + 1 / of[some])
        if some.any():
            model.limits[some, 2] = np.maximum(model.limits[some, 2], np.median(model.limits[some, 2]))
    return model


def decided(m: Model, bits: np.ndarray, counts: np.ndarray, letters: np.ndarray, tolerance: float) -> tuple[np.ndarray, ...]:
    """(best language, its bits a character, whether the text has letters, whether the prediction is accepted)."""
    best = bits.argmin(axis=1) if len(bits) else np.zeros(0, np.int64)
    n = np.maximum(counts, 1)
    ce = bits[np.arange(len(best)), best] / n
    mean, between, within = m.limits[best].T if len(best) else (np.zeros(0),) * 3
    known = letters & (counts > 0)
    return best, ce, known, known & (ce <= mean + tolerance * (between + within / np.sqrt(n)))


def posterior(bits: np.ndarray, kappa: float) -> np.ndarray:
    """Weights of the languages, 0 to 1, from their bits."""
    x = -kappa * np.log(2) * (bits - bits.min(axis=1, keepdims=True))
    e = np.exp(np.maximum(x, -700))
    return e / e.sum(axis=1, keepdims=True)


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = 10_000, calibration_docs: int = 2000, tolerance: float = 8.0) -> DataFrame:
    """Predicted language of every whole text: doc_id, held_out, lang_pred, score, cross_entropy, accepted.

    Learns from labelled rows whose crc32(identifier) mod 5 is not 0, about `train_docs` of each language (the bound of
    the classifier's sample, see `train`); a prediction uses the text alone. The
    language of lowest cross-entropy (bits a character) wins, of equal ones the first by name. score is its share of
    the sharpened likelihoods. accepted is false for `und` and for texts whose cross-entropy lies `tolerance`
    spreads above what calibration texts of that language have that its model has not learned: mean + tolerance * (spread between texts +
    spread within a text / sqrt(characters)).

    Null text, empty text and text without a letter: lang_pred `und`, score 0, not accepted. Null labels are not learned, nor
    is a language whose labelled texts are all null or empty; when none is left, every text is `und`. A language that has
    text in one calibration fold alone (one row, copies of one row) accepts whatever is not worse than chance. Repeated rows count as often as they occur. An empty table gives
    no rows. Other columns are ignored. A very long text is scored as a whole in memory that follows its own length.
    Texts are read for the sample and for scoring; only the sample's gram counts are shuffled.
    """
    ship(docs.sparkSession)
    model = train(docs, id_col, text_col, lang_col, train_docs, calibration_docs)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"))
    held = (fold("doc_id", 5) == 0).alias("held_out")
    if not model.langs:
        return rows.select("doc_id", held, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(False).alias("accepted"))

    def give(m, b, bits, counts, letters):
        best, ce, known, ok = decided(m, bits, counts, letters, tolerance)
        score = np.where(known, posterior(bits, m.kappa).max(axis=1), 0.0) if len(best) else np.zeros(0)
        names = np.where(known, np.array(m.langs, object)[best], UNKNOWN) if len(best) else np.zeros(0, object)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(np.where(known, ce, np.nan), from_pandas=True), pa.array(ok)], names=["doc_id", "lang_pred", "score", "cross_entropy", "accepted"])

    out = _measured(rows, model, f"doc_id {kind}, lang_pred string, score double, cross_entropy double, accepted boolean", give)
    return out.select("doc_id", held, "lang_pred", "score", "cross_entropy", "accepted")


def keep_accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = 10_000, calibration_docs: int = 2000, tolerance: float = 8.0) -> DataFrame:
    """The rows whose texts get an accepted prediction (see identify_language), with all their columns; without any
    labelled row there is nothing to accept by, and all texts stay. No row is joined or shuffled."""
    ship(docs.sparkSession)
    model = train(docs, id_col, text_col, lang_col, train_docs, calibration_docs)
    if not model.langs:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def accepted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            m, out = sent.value, np.zeros(len(column), bool)
            for part, bits, counts, letters, _ in _scored(m, column):
                out[part] = decided(m, bits, counts, letters, tolerance)[3]
            yield pa.array(out)

    return docs.where(F.arrow_udf(accepted, "boolean", F.ArrowUDFType.SCALAR_ITER)(docs[text_col]))
