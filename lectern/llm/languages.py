"""Language of every document and of every passage (problem 8).

Results for odd input: a null or empty text, one without letters, and one in a language that has no prototype (too many of its
trigrams stand in no sample), has no language (``und``, confidence 0) and holds
no passage with letters; repeated documents each get their own rows; an empty table gives no rows; columns of
other names are carried by the caller, as the operators only take the columns named to them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hyperlang

LANGUAGES = ("de", "en", "es", "fr", "nl", "pt")

#: Bounds of the labelled sample that the prototypes are made from.
SAMPLE_DOCUMENTS = 150
SAMPLE_CHARS = (200, 4000)

#: A segment with fewer letters, or with a smaller lead for each of its characters, follows its document.
MIN_LETTERS = 12
MIN_LEAD = 0.0015
#: Share of the trigrams that a text, and a sentence, of a known language must have in common with the samples, of what they should have.
KNOWN_TEXT, KNOWN_SENTENCE = 0.8, 0.6
BLOCK = 400_000

_NAMES = {
    "en": "en eng english", "de": "de deu ger german deutsch", "fr": "fr fra fre french francais français",
    "es": "es spa spanish espanol español castellano", "pt": "pt por portuguese portugues português",
    "nl": "nl nld dut dutch nederlands",
}

#: First article of the Universal Declaration of Human Rights: the sample of a language that has no labelled row.
_SEED = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geiste der Brüderlichkeit begegnen.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade.",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen.",
}


def label_language(column):
    """Two-letter code that a label names, whatever its spelling or region; null if it names none of the six."""
    base = F.regexp_extract(F.lower(F.trim(column)), r"^([\p{L}]+)", 1)
    out = F.lit(None).cast("string")
    for code, names in _NAMES.items():
        out = F.when(base.isin(*names.split()), F.lit(code)).otherwise(out)
    return out


def train_profiles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> hyperlang.Profiles:
    """Prototypes from at most SAMPLE_DOCUMENTS labelled documents of each language, the first by a hash of
    their ids; wrong labels among them are outweighed in the bundle."""
    # ids and labels give twice as many as are wanted, their texts are read in one pass, and the first ones of fitting length stay
    labelled = docs.select(F.col(id_col).alias("id"), label_language(F.col(label_col)).alias("code")).filter(F.col("code").isNotNull())
    order = Window.partitionBy("code").orderBy(F.xxhash64("id"), "id")
    picked = labelled.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= 2 * SAMPLE_DOCUMENTS)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.length("text").between(*SAMPLE_CHARS))
    # repeated ids may repeat a text: the bound holds for them too
    first = texts.join(F.broadcast(picked), "id").withColumn("nth", F.row_number().over(Window.partitionBy("code").orderBy("at", "text"))).filter(F.col("nth") <= SAMPLE_DOCUMENTS)
    rows = first.select("code", "text").collect()
    samples: dict[str, list[str]] = {code: [] for code in LANGUAGES}
    for r in rows:
        samples[r.code].append(r.text)
    return hyperlang.train({k: sorted(v) or [_SEED[k]] for k, v in samples.items()})


_QUOTED = re.compile(r'"[^"\n]{1,80}"|«[^»\n]{1,80}»|„[^“”\n]{1,80}[“”]|“[^”\n]{1,80}”')


def _without_quotations(text: str) -> str:
    """Quoted words take no part in telling the language of their sentence; lengths stay."""
    if '"' in text or "«" in text or "„" in text or "“" in text:
        return _QUOTED.sub(lambda m: " " * len(m.group()), text)
    return text


class Analysis:
    """Segments of a block of texts: a segment ends after a sentence or a line."""

    def __init__(self, texts: list[str], profiles: hyperlang.Profiles):
        gap = "\n\n\n"
        self.cp = cp = hyperlang.points("".join(_without_quotations(t) + gap for t in texts))
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.doc_start = np.concatenate([[0], np.cumsum(lengths + len(gap))])[:-1]
        self.doc_end = self.doc_start + lengths
        sym = hyperlang.symbols(cp)
        letter = sym > 0
        space = (cp == 32) | (cp == 10) | (cp == 9) | (cp == 13) | (cp == 0xA0)
        mark = (cp == 46) | (cp == 33) | (cp == 63) | (cp == 0x2026)
        after = lambda a, k: np.concatenate([a[k:], np.ones(k, dtype=bool)])
        before = lambda a, k: np.concatenate([np.zeros(k, dtype=bool), a[:-k]])
        closer = (cp == 34) | (cp == 39) | (cp == 41) | (cp == 93) | (cp == 0xBB) | (cp == 0x201D) | (cp == 0x2019)
        digit = (cp >= 48) & (cp <= 57)
        # "p. 212": a point after one or two letters and before a number ends nothing
        short = (cp == 46) & before(letter, 1) & (~before(letter, 2) | ~before(letter, 3)) & after(digit, 2)
        ends = mark & (after(space, 1) | (after(closer, 1) & after(space, 2))) & ~short
        cut = ends | (cp == 10)
        self.starts = starts = np.unique(np.concatenate([np.flatnonzero(cut) + 1, self.doc_start]))[:]
        self.starts = starts = starts[starts < len(cp)]
        self.doc = np.searchsorted(self.doc_start, starts, side="right") - 1
        self.scores = self._scores(profiles, sym, starts)
        self.letters = np.add.reduceat(letter.astype(np.int32), starts)
        first = np.minimum(starts + (cp[starts] == 32), len(cp) - 2)
        reference = (cp[first] == 91) & digit[first + 1]
        self.full = (np.add.reduceat(ends.astype(np.int32), starts) > 0) & (self.letters >= MIN_LETTERS) & ~reference
        self.profiles = profiles
        codes = hyperlang.trigram_codes(sym)
        told, some = np.add.reduceat((profiles.known[codes]).astype(np.int32), starts), np.add.reduceat((codes > 0).astype(np.int32), starts)
        self.foreign = told < KNOWN_SENTENCE * profiles.coverage * some
        n = len(self.doc_start)
        self.outside = np.bincount(self.doc, weights=told, minlength=n) < KNOWN_TEXT * profiles.coverage * np.bincount(self.doc, weights=some, minlength=n)

    @staticmethod
    def _scores(profiles, sym, starts):
        out = np.zeros((len(starts), len(profiles.languages)), dtype=np.float64)
        codes = hyperlang.trigram_codes(sym)
        cuts = np.unique(np.concatenate([starts, np.arange(0, len(sym), BLOCK)]))
        owner = np.searchsorted(starts, cuts, side="right") - 1
        at = 0
        while at < len(cuts):
            to = max(at + 1, np.searchsorted(cuts, cuts[at] + BLOCK))
            stop = cuts[to] if to < len(cuts) else len(sym)
            rows = profiles.table[codes[cuts[at] : stop]]
            np.add.at(out, owner[at:to], np.add.reduceat(rows, cuts[at:to] - cuts[at], axis=0))
            at = to
        return out

    def resolve(self):
        """Main language of each text, language of each segment, and sentences in full of each text by language."""
        k, n = len(self.profiles.languages), len(self.doc_start)
        totals = np.zeros((n, k))
        np.add.at(totals, self.doc, self.scores)
        letters = np.bincount(self.doc, weights=self.letters, minlength=n)
        main = np.where((letters > 0) & (totals.max(axis=1) > 0) & ~self.outside, totals.argmax(axis=1), -1)
        best = self.scores.argmax(axis=1)
        top = np.partition(self.scores, -2, axis=1)[:, -2:] if k > 1 else np.repeat(self.scores, 2, axis=1)
        sure = ~self.foreign & ~self.outside[self.doc] & (self.letters >= MIN_LETTERS) & (np.abs(top[:, 1] - top[:, 0]) >= MIN_LEAD * np.maximum(self.letters, 1))
        lang = np.where(sure, best, main[self.doc])
        count = np.zeros((n, k), dtype=np.int64)
        good = self.full & sure
        np.add.at(count, (self.doc[good], lang[good]), 1)
        return main, lang, count, totals


def _confidence(scores: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Lead of the chosen language's cosine over the best other one, as a share of both; the text's length cancels."""
    rows = np.arange(len(scores))
    own = scores[rows, at]
    rest = scores.copy()
    rest[rows, at] = -np.inf
    other = rest.max(axis=1) if scores.shape[1] > 1 else np.zeros(len(scores))
    return np.clip((own - other) / np.maximum(np.abs(own) + np.abs(other), 1e-12), 0.0, 1.0)


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _bare(profiles) -> bool:
    return not profiles.languages


def detect_languages(docs: DataFrame, profiles: hyperlang.Profiles, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """One row for each document and language that it holds: ``doc_id, label, found_lang, confidence, sentences, held``.

    A document holds the languages of which it has two full sentences; if there is none, its main language.  ``held`` is the
    number of languages.  Narrow: texts are scored where they are read, nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        names = np.array([*known.languages, "und"], dtype=object)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            for a, b in _blocks(texts):
                part = Analysis(texts[a:b], known)
                main, _, count, totals = part.resolve()
                holds = count >= 2
                none = ~holds.any(axis=1)
                rows_main = np.flatnonzero(none)
                doc, lang = np.nonzero(holds)
                doc, lang = np.concatenate([doc, rows_main]), np.concatenate([lang, main[rows_main]])
                ids, labels = batch["id"].to_numpy()[a:b], batch["label"].to_numpy()[a:b]
                yield pd.DataFrame(
                    {
                        "id": ids[doc], "label": labels[doc], "found_lang": names[lang],
                        "confidence": np.where(lang < 0, 0.0, _confidence(totals[doc], np.maximum(lang, 0))),
                        "sentences": np.where(lang < 0, 0, count[doc, np.maximum(lang, 0)]),
                        "held": np.maximum(holds.sum(axis=1), 1)[doc],
                    }
                )

    narrow = docs.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    out = narrow.mapInPandas(run, f"id {id_type}, label string, found_lang string, confidence double, sentences bigint, held bigint")
    return out.withColumnRenamed("id", id_col)


def language_passages(docs: DataFrame, profiles: hyperlang.Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages of one language each: ``doc_id, passage_no, char_start, char_end, found_lang, confidence``.

    Offsets count UTF-16 units; the passages of a text follow each other without a gap and cover it."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        names = np.array([*known.languages, "und"], dtype=object)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            for a, b in _blocks(texts):
                part = Analysis(texts[a:b], known)
                _, lang, _, _ = part.resolve()
                inside = part.starts < part.doc_end[part.doc]
                starts, doc, lang, scores = part.starts[inside], part.doc[inside], lang[inside], part.scores[inside]
                if not len(starts):
                    continue
                new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (lang[1:] != lang[:-1])])
                heads = np.flatnonzero(new)
                d, l = doc[heads], lang[heads]
                sums = np.add.reduceat(scores, heads, axis=0)
                units = np.concatenate([[0], np.cumsum(1 + (part.cp >= 0x10000))])
                start = starts[heads]
                last = np.concatenate([d[1:] != d[:-1], [True]])
                end = np.where(last, part.doc_end[d], np.concatenate([start[1:], [0]]))
                base = units[part.doc_start[d]]
                first = np.concatenate([[True], d[1:] != d[:-1]])
                number = np.arange(len(d)) - np.flatnonzero(first)[np.cumsum(first) - 1]
                yield pd.DataFrame(
                    {
                        "id": batch["id"].to_numpy()[a:b][d], "passage_no": number, "char_start": units[start] - base, "char_end": units[end] - base,
                        "found_lang": names[l], "confidence": np.where(l < 0, 0.0, _confidence(sums, np.maximum(l, 0))),
                    }
                )

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = narrow.mapInPandas(run, f"id {id_type}, passage_no int, char_start int, char_end int, found_lang string, confidence double")
    return out.withColumnRenamed("id", id_col)


def mislabelled(detected: DataFrame) -> DataFrame:
    """Rows of detect_languages whose document has no usable label, a wrong one, or several languages."""
    label = label_language(F.col("label"))
    return detected.filter(label.isNull() | (label != F.col("found_lang")) | (F.col("held") > 1)).filter(F.col("found_lang") != "und")
