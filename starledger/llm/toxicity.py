"""Toxicity by weak supervision.

1. Voters. Lexicon voters are insults of a fixed list and stems (whole words and word beginnings of 4 to 7 bytes) that the labelled
   sample ties to toxic texts; each votes toxic where its stem occurs, or occurs in two words or more, and abstains elsewhere. Pattern voters look at the
   form of a text (shouting, exclamation marks, few distinct words, none of these) and at whether two lexicon voters fire, or none.
2. Label model. A generative model with a latent class over a sample of labelled and other documents, whose labels it doesn't see: from where
   the voters agree, expectation maximisation estimates how often each voter fires in either class, and the
   correlation of voters within a class; a voter's evidence is divided among those that go along with it. Its posterior
   is the training label of each text. Labels choose the lexicon and tell which class is the toxic one.
3. Linear classifier. Logistic regression on the posteriors, over the presence of the sample's telling stems.
   Stems are compared by 64-bit hash, so a long text doesn't hit them by chance.

Whole texts are scored in tasks, the models are fitted in one, and the driver sees only the counts of the bounded sample's stems.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import labelled_sample
from .scoring import fitted
from .shared import Scratch
from .wordbytes import MIX, starts_and_terms, stretches

#: Labelled documents to learn from, and others for the label model, at most.
SAMPLE, UNLABELLED = 12_000, 6_000
#: Lexicon voters, and features of the classifier, at most.
VOTERS, FEATURES = 128, 4096
_STEMS = (4, 5, 6, 7)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(128, 256)]] = True
_CHUNK = 1_000_000
_TWICE = np.uint64(0x5851F42D4C957F2D)
_PATTERNS = 4
#: A stem counts from so many texts on.
_RARE = 3
#: A learned voter has to be right so often where it fires, with so many more texts of the sample's toxic share counted to it.
_RIGHT, _SHRINK = 0.6, 2.0
#: Classes of the label model whose probabilities in toxic and clean texts differ by less aren't the labels' classes.
_APART = 0.1
# Common insults of four languages, each a voter where a word is it or begins with its first 7 bytes.
INSULTS = """
abruti arschloch abschaum asqueroso asshole basura bastard bitch blöd cabrón clown connard coward crétin cretino depp disgusting dreckig dégoûtant débile dumb dumm
ekelhaft erbärmlich escoria estúpido filthy fool freak fuck garbage gilipollas hurensohn hässlich hate idiot imbecile imbécil imbécile inútil jerk liar loser lügner
mentiroso menteur merde mierda minable mistkerl moron müll nichtsnutz ordure patético pathetic pathétique payaso perdedor putain retard salaud salope scheiß scheiss
schlampe schwachkopf scum shit slut stupid stupide tarado tonto trash trottel ugly useless vermin versager vollidiot wertlos whore widerlich worthless
""".split()
_UPPER = np.fromiter((not 0xD800 <= c <= 0xDFFF and chr(c).isupper() for c in range(0x20000)), bool, 0x20000)


def _counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of a text's words and word beginnings, sorted, and how many words have each."""
    every = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    inside = _LETTER[every]
    out = []
    for start, end in stretches(inside, _CHUNK):
        letter = inside[start:end]
        starts, since, terms = starts_and_terms(every[start:end], letter)
        if not len(starts):
            continue
        length = np.add.reduceat(letter, starts, dtype=np.int64)
        part = [np.add.reduceat(terms, starts) * MIX]
        for n in _STEMS:
            begun = np.add.reduceat(np.where(since < n, terms, np.uint64(0)), starts)
            part.append((begun * MIX + np.uint64(n))[length > n])
        out.append(np.unique(np.concatenate(part), return_counts=True))
    if len(out) < 2:
        return out[0] if out else (np.empty(0, np.uint64), np.empty(0, np.int64))
    stem, place = np.unique(np.concatenate([s for s, _ in out]), return_inverse=True)
    return stem, np.bincount(place, np.concatenate([n for _, n in out]), len(stem)).astype(np.int64)


def stems(text: str | None) -> np.ndarray:
    """Hashes of a text's words and word beginnings, distinct and sorted. Words are runs of letters; case is dropped."""
    return _counted(text)[0]


def signs(text: str | None) -> np.ndarray:
    """Hashes of a text's stems, and others of those that two words or more have, sorted."""
    stem, n = _counted(text)
    return np.unique(np.concatenate([stem, (stem[n > 1] ^ _TWICE) * MIX]))


def insults() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the fixed list's words and word beginnings, and which voter each belongs to."""
    hashes, owner = [], []
    for i, word in enumerate(INSULTS):
        raw = np.frombuffer(word.encode(), np.uint8)
        terms = starts_and_terms(raw, np.ones(len(raw), bool))[2]
        n = min(len(raw), _STEMS[-1])
        hashes += [np.add.reduce(terms[:, None]) * MIX, np.add.reduce(terms[:n, None]) * MIX + np.uint64(n)]
        owner += [i, i]
    return np.concatenate(hashes), np.array(owner)


def patterns(text: str | None) -> np.ndarray:
    """Votes of form: shouting, many exclamation or question marks, few distinct words, none of these."""
    t = text or ""
    n = max(1, len(t))
    points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
    upper = int(_UPPER[points[points < len(_UPPER)]].sum()) / n
    words = t.split()
    v = np.array([upper > 0.4, (t.count("!") + t.count("?")) > 0.02 * n, len(words) > 20 and len(set(words)) < 0.3 * len(words)], bool)
    return np.append(v, not v.any())


@dataclass
class LabelModel:
    """Rates at which voters fire in the clean and the toxic class, their within-class correlation and weight."""

    prior: float
    rates: np.ndarray
    correlation: np.ndarray
    weight: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        hit = np.log(self.rates[1] / self.rates[0]) * self.weight
        miss = np.log((1 - self.rates[1]) / (1 - self.rates[0])) * self.weight
        z = np.log(self.prior / (1 - self.prior)) + votes @ (hit - miss) + miss.sum()
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 50) -> tuple[LabelModel, np.ndarray]:
    """Estimate by expectation maximisation from a first guess of each text's probability; the model and each text's posterior.

    No label is seen. Two voters are correlated if, within the classes, they fire together more (or less) often than by chance; a
    voter's weight is 1 over the sum of its correlations of more than 0.2, itself included.
    """
    votes = votes.astype(np.float64)
    q, model = start, None
    for _ in range(rounds):
        mass = np.array([(1 - q).sum(), q.sum()])
        rates = np.stack([((1 - q) @ votes + 0.1) / (mass[0] + 1), (q @ votes + 0.1) / (mass[1] + 1)])
        rates = np.clip(rates, 1e-5, 1 - 1e-5)
        # within each class, so that what the class explains isn't taken for correlation
        mean = (1 - q)[:, None] * rates[0] + q[:, None] * rates[1]
        cov = (votes.T @ votes - mean.T @ votes - votes.T @ mean + mean.T @ mean) / max(1, len(votes))
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        correlation = np.clip(cov / np.outer(sd, sd), -1, 1)
        np.fill_diagonal(correlation, 1)
        weight = 1 / np.where(np.abs(correlation) > 0.2, np.abs(correlation), 0).sum(axis=1)
        model = LabelModel(float(np.clip(mass[1] / max(mass.sum(), 1e-9), 1e-3, 1 - 1e-3)), rates, correlation, weight)
        new = model.posterior(votes)
        done = np.abs(new - q).max(initial=0) < 1e-4
        q = new
        if done:
            break
    return model, q


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        n = len(self.features)
        for i, t in enumerate(texts):
            z = self.bias
            s = signs(t)
            if n and len(s):
                at = np.searchsorted(s, self.features)
                hit = s[np.minimum(at, len(s) - 1)] == self.features
                z += float(self.weights[hit].sum())
            out[i] = 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))
        return out


def _covering(candidates: np.ndarray, texts: list[np.ndarray], labels: np.ndarray, enough: int = 4) -> np.ndarray:
    """Up to VOTERS of the candidates, best first, without those whose toxic texts others already cover enough."""
    covered, out = np.zeros(len(labels), np.int64), []
    for c, t in zip(candidates, texts, strict=True):
        t = t[labels[t] == 1]
        if (covered[t] < enough).mean() >= 0.2:
            covered[t] += 1
            out.append(c)
            if len(out) == VOTERS:
                break
    return np.array(out, np.int64)


def choose(stem: np.ndarray, total: np.ndarray, a: np.ndarray, n: int, toxic: int) -> tuple[np.ndarray, np.ndarray]:
    """Stems that may be lexicon voters, best first, and the classifier's, from counts in all and in toxic texts."""
    order = np.argsort(stem)
    stem, total, a = stem[order], total[order].astype(float), a[order].astype(float)
    b = total - a
    odds = np.log((a + 0.2) / (toxic + 1)) - np.log((b + 0.2) / (n - toxic + 1))
    sure = odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))  # in standard errors, so that a small sample ties few stems
    # the share of toxic texts among those that have the stem, shrunk towards that of all
    right = (a + _SHRINK * toxic / max(1, n)) / (total + _SHRINK)
    voters = np.flatnonzero((a >= _RARE) & (right >= _RIGHT))
    voters = voters[np.argsort(-right[voters] * np.sqrt(a[voters]), kind="stable")]
    telling = np.flatnonzero((total >= _RARE) & (np.abs(sure) > 2.5))
    telling = telling[np.argsort(-np.abs(sure[telling]), kind="stable")][:FEATURES]
    return stem[voters], stem[telling]


def guess(fired: np.ndarray) -> np.ndarray:
    """First guess from agreement: toxic where two lexicon voters agree, less likely where one fires, clean where none does."""
    return np.select([fired >= 2, fired == 1], [0.9, 0.2], 0.02)


def train(
    candidates: np.ndarray, telling: np.ndarray, hits: list[np.ndarray], forms: np.ndarray, labels: np.ndarray, fixed: np.ndarray | None = None,
) -> tuple[Model, LabelModel | None, np.ndarray]:
    """The classifier, the label model and its posterior for each text.

    hits: for each text the places in ``candidates`` followed by ``telling`` of the stems it has; forms: votes of its patterns; labels: -1
    where there is none. The first candidates belong to the fixed voters that ``fixed`` names, one number for each.
    """
    fixed = np.empty(0, np.int64) if fixed is None else fixed
    n, known = len(labels), labels >= 0
    toxic = int((labels == 1).sum())
    prior = (toxic + 0.5) / (known.sum() + 1)
    even = Model(np.empty(0, np.uint64), np.empty(0), float(np.log(prior / (1 - prior)))), None, np.full(n, prior)
    if not 0 < toxic < known.sum():
        return even
    own = np.repeat(np.arange(n, dtype=np.int32), [len(h) for h in hits])
    place = np.concatenate(hits)
    lexical = place < len(candidates)
    by_stem = np.argsort(place[lexical], kind="stable")
    texts = np.split(own[lexical][by_stem], np.cumsum(np.bincount(place[lexical], minlength=len(candidates)))[:-1]) if len(candidates) else []
    sets = [np.concatenate([texts[p] for p in np.flatnonzero(fixed == v)]) for v in np.unique(fixed)]
    sets = [t for t in sets if len(t)]
    voters = len(fixed) + _covering(np.arange(len(candidates) - len(fixed)), texts[len(fixed) :], labels)
    sets += [texts[v] for v in voters]

    if not sets:
        return even
    voters = np.arange(len(sets))
    votes = np.zeros((n, len(voters) + _PATTERNS + 2), bool)
    for i, t in enumerate(sets):
        votes[t, i] = True
    fired = votes[:, : len(voters)].sum(axis=1)
    votes[:, len(voters) : -2] = forms
    votes[:, -2], votes[:, -1] = fired >= 2, fired == 0
    model, target = label_model(votes, guess(fired))
    apart = target[labels == 1].mean() - target[labels == 0].mean()
    if abs(apart) < _APART:  # the voters agree on something else than toxicity: the labels themselves are the target
        model, target = None, np.where(known, labels == 1, prior).astype(float)
    elif apart < 0:  # labels say which class is which
        model.prior, model.rates, target = 1 - model.prior, model.rates[::-1], 1 - target

    row, col = own[~lexical], place[~lexical] - len(candidates)
    w, bias = np.zeros(len(telling)), float(np.log(target.sum() / (n - target.sum())))
    seen, seen_b = np.full(len(telling), 1e-8), 1e-8
    for _ in range(300):
        z = np.bincount(row, w[col], n) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        grad = np.bincount(col, g[row], len(telling)) + 0.3 / n * w
        seen += grad**2
        seen_b += g.sum() ** 2
        w -= 0.3 * grad / np.sqrt(seen)
        bias -= 0.3 * g.sum() / np.sqrt(seen_b)
    order = np.argsort(telling)
    return Model(telling[order], w[order], float(bias)), model, target


def _slices(it: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for b in it:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _featurize(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _slices(it):
        texts = b.column("text").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [b.column("label"), pa.array([signs(t).tobytes() for t in texts], pa.binary()), pa.array([patterns(t).tobytes() for t in texts], pa.binary())], ["label", "stems", "forms"]
        )


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of labelled texts: how many, and how many toxic ones, have a stem. The null stem counts the texts."""
    for b in _slices(it):
        b = b.filter(b.column("label").is_valid())
        if not b.num_rows:
            continue
        sets = [np.frombuffer(s, np.uint64) for s in b.column("stems").to_pylist()]
        y = b.column("label").to_numpy()
        stem, place = np.unique(np.concatenate(sets), return_inverse=True)
        n, toxic = np.bincount(place, minlength=len(stem)), np.bincount(place, np.repeat(y, [len(s) for s in sets]), len(stem)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([*stem.view(np.int64).tolist(), None], pa.int64()), pa.array(np.append(n, len(y))), pa.array(np.append(toxic, y.sum()).astype(np.int64))], ["stem", "n", "toxic"])


def _chosen(counts: pa.Table | None) -> tuple[np.ndarray, np.ndarray]:
    none = np.empty(0, np.uint64)
    if counts is None:
        return none, none
    stem, total, toxic = (counts.column(c) for c in ("stem", "n", "toxic"))
    whole = stem.is_null().to_numpy(zero_copy_only=False)
    total, toxic = total.to_numpy(), toxic.to_numpy()
    n, bad = int(total[whole].sum()), int(toxic[whole].sum())
    return choose(stem.filter(pa.array(~whole)).to_numpy().view(np.uint64), total[~whole], toxic[~whole], n, bad) if 0 < bad < n else (none, none)


def _trainer(candidates: np.ndarray, telling: np.ndarray, fixed: np.ndarray):
    def made(found: pa.Table | None) -> Model:
        if found is None:
            return train(candidates, telling, [], np.empty((0, _PATTERNS), bool), np.empty(0, np.int64), fixed)[0]
        label = found.column("label").fill_null(-1).to_pylist()
        rows = sorted(zip(label, found.column("hits").to_pylist(), found.column("forms").to_pylist(), strict=True))  # as arrival order varies
        forms = np.array([np.frombuffer(f, bool) for _, _, f in rows])
        return train(candidates, telling, [np.frombuffer(h, np.int32) for _, h, _ in rows], forms, np.array([y for y, _, _ in rows], np.int64), fixed)[0]

    return made


def _finder(candidates: np.ndarray, telling: np.ndarray):
    every = np.concatenate([candidates, telling])
    order = np.argsort(every, kind="stable")
    ranked = every[order]

    def find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(it):
            out = []
            for raw in b.column("stems").to_pylist():
                s = np.frombuffer(raw, np.uint64)
                at = np.minimum(np.searchsorted(s, ranked), max(0, len(s) - 1))
                out.append(np.sort(order[s[at] == ranked]).astype(np.int32).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(out, pa.binary()), b.column("forms")], ["label", "hits", "forms"])

    return find


def fit(docs: DataFrame, labels: DataFrame, learn, most: int = SAMPLE, unlabelled: int = UNLABELLED) -> Model:
    """Learn from at most ``most`` labelled and ``unlabelled`` other documents; without both labels among them, or any voter that fires, scores are the prior.

    Null texts, ids and labels aren't learned from, a document labelled or present twice counts once, and columns other than
    doc_id, text and the label are ignored. Empty tables give an even prior. Stems of very few texts don't leave the executors.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.keep(labelled_sample(docs, labels, "toxic", learn, most, unlabelled).mapInArrow(_featurize, "label int, stems binary, forms binary"), "sample")
    counts = sample.mapInArrow(_count, "stem long, n long, toxic long").groupBy("stem").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    candidates, telling = fitted(counts.where(f"n >= {_RARE} or stem is null"), _chosen)
    known, fixed = insults()
    # whatever votes is a feature too
    candidates, telling = np.concatenate([known, candidates]), np.unique(np.concatenate([known, candidates[:VOTERS], telling]))
    model = fitted(sample.mapInArrow(_finder(candidates, telling), "label int, hits binary, forms binary"), _trainer(candidates, telling, fixed))
    scratch.drop("sample")
    return model
