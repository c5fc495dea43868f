"""Language profiles with hyperdimensional vectors (problem 8).

Every letter has a random bipolar vector of ``DIM`` components.  A letter trigram is the product of its letters'
vectors, the first rotated twice and the second once, so that order matters.  A language is the bundle (sum) of
the trigrams of its sample texts; a text is the bundle of its own trigrams and is compared with every language by
cosine.  Because bundling is a sum, the dot product of a text with a language is the sum over the text's trigrams
of the trigram's dot product with the language: :func:`train` computes those once, as a table of
``SYMBOLS ** 3`` rows, and a text costs one table row for each character.  The length of the text's own
bundle is the same factor for all languages and does not change their order; confidences are ratios of
cosines, in which it cancels.  Trigrams that no sample has are orthogonal to every language but for noise and count
as nothing; a text with many of them is in none of the languages.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DIM = 2048
SEED = 20
SYMBOLS = 64
_BITS = 6
_LETTERS = "abcdefghijklmnopqrstuvwxyzàâáãäçéèêëíîïñóôõöúùûüßœæ"
_TABLE_POINTS = 0x3000


def _symbol_table() -> np.ndarray:
    """Code point to symbol: 0 for everything that is no letter, one symbol for each letter of the six languages in
    either case, and the remaining symbols shared by all other letters."""
    known = {c: i + 1 for i, c in enumerate(_LETTERS)}
    first_free = len(known) + 1
    out = np.zeros(_TABLE_POINTS, dtype=np.uint8)
    for point in range(_TABLE_POINTS):
        c = chr(point)
        if c.isalpha():
            low = c.lower()[0]
            out[point] = known.get(low) or first_free + ord(low) % (SYMBOLS - first_free)
    return out


SYMBOL_OF = _symbol_table()
_PLAIN = np.zeros(SYMBOLS, dtype=np.uint8)
_PLAIN[: len(_LETTERS) + 1] = np.arange(len(_LETTERS) + 1)
for _c, _base in zip("àâáãäçéèêëíîïñóôõöúùûü", "aaaaaceeeeiiinoooouuuu"):
    _PLAIN[_LETTERS.index(_c) + 1] = _LETTERS.index(_base) + 1
_PLAIN[len(_LETTERS) + 1 :] = np.arange(len(_LETTERS) + 1, SYMBOLS)


def points(text: str) -> np.ndarray:
    """Code points; lone surrogates pass."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def symbols(cp: np.ndarray) -> np.ndarray:
    out = SYMBOL_OF[np.minimum(cp, _TABLE_POINTS - 1)]
    high = cp >= _TABLE_POINTS
    if high.any():
        out[high] = SYMBOLS - 1
    return out


def trigram_codes(sym: np.ndarray) -> np.ndarray:
    """Code of the trigram that ends at each position; 0 where two or more of the three are no letters."""
    s = sym.astype(np.int32)
    code = s.copy()
    code[1:] |= s[:-1] << _BITS
    code[2:] |= s[:-2] << (2 * _BITS)
    blank = (s == 0).astype(np.int8)
    blanks = blank.copy()
    blanks[1:] += blank[:-1]
    blanks[2:] += blank[:-2]
    blanks[:2] = 3
    code[blanks > 1] = 0
    return code


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    letters = np.random.default_rng(SEED).choice(np.array([-1, 1], dtype=np.int8), size=(SYMBOLS, DIM))
    a, b, c = codes >> (2 * _BITS), (codes >> _BITS) & (SYMBOLS - 1), codes & (SYMBOLS - 1)
    return np.roll(letters, 2, axis=1)[a] * np.roll(letters, 1, axis=1)[b] * letters[c]


@dataclass(frozen=True)
class Profiles:
    languages: tuple[str, ...]
    table: np.ndarray  # SYMBOLS ** 3 rows, one column for each language
    known: np.ndarray  # whether a sample has the trigram
    coverage: float  # share of the trigrams of further texts that the samples should have (Good and Turing's estimate)


def train(samples: dict[str, list[str]]) -> Profiles:
    """Prototypes from sample texts of each language, bundled as written and with accents taken off.

    Counts enter by their square root, so that a few very frequent words do not fill the bundle; what all
    languages share is taken off, so that cosines compare what tells them apart."""
    languages = tuple(sorted(k for k, v in samples.items() if any(v)))
    counts = np.zeros((len(languages), SYMBOLS**3))
    written = np.zeros(SYMBOLS**3)
    for i, lang in enumerate(languages):
        for text in samples[lang]:
            sym = symbols(points(text or ""))
            for form in (sym, _PLAIN[sym]):
                counts[i] += np.bincount(trigram_codes(form), minlength=SYMBOLS**3)
            written += np.bincount(trigram_codes(sym), minlength=SYMBOLS**3)
    counts[:, 0] = written[0] = 0
    seen = np.flatnonzero(counts.sum(axis=0))
    table = np.zeros((SYMBOLS**3, len(languages)), dtype=np.float32)
    if len(seen):
        share = counts[:, seen] / np.maximum(counts[:, seen].sum(axis=1, keepdims=True), 1)
        vectors = trigram_vectors(seen).astype(np.float32)
        proto = np.sqrt(share).astype(np.float32) @ vectors
        proto /= np.maximum(np.linalg.norm(proto, axis=1, keepdims=True), 1e-9)
        proto -= proto.mean(axis=0, keepdims=True)
        table[seen] = vectors @ proto.T / np.sqrt(DIM)
    coverage = 1 - np.count_nonzero(written == 1) / max(written.sum(), 1)
    return Profiles(languages, table, counts.sum(axis=0) > 0, float(coverage))


def score_spans(profiles: Profiles, sym: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of the table rows over each span; spans follow each other from starts[i] to starts[i + 1]."""
    rows = profiles.table[trigram_codes(sym)]
    return np.add.reduceat(rows, starts, axis=0)
