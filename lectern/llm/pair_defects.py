"""Broken prompt and response pairs (problem 4).

A response is cut into clauses.  A linear-chain conditional random field tags each as answer, refusal, echo of the question,
foreign or unfinished.  Its features are read from the text: the clause's words, pairs of words and beginnings of words (words of the
question and numbers as one symbol each), its last word if it ends openly and how often that word ends a sentence in the sample,
its overlap with the question, its language against the question's, its closing marks and its place.  The letters that each
tag covers make the defect of the pair: all refusal, all echo, mostly foreign, or an unfinished last clause.  Responses without
words, or with a placeholder, have no clauses and are empty.

The field is fitted on tagged examples (below) and on a bounded sample of the rows themselves, at most SAMPLE_REFUSED responses
that carry a reason in ``refusal``, SAMPLE_OPEN that end without a closing mark and SAMPLE_OTHERS, the first by a hash of their texts.  Responses with a reason are
tagged refusal; long ones without are tagged answer, echo or foreign by their overlap and language, and once more cut at random,
which makes the last clause unfinished.  Responses that end openly after a closed clause, an open bracket or a bare mark are unfinished; those of one clause
are tagged by how much they differ from cuts: what is frequent among them and rare among cuts is a short complete answer.  A second fit adds the rest of the sample with the tags that the first one gives.

Results for odd input: a null question is an empty one (nothing is an echo of it or in another language); a null response
is an empty one; a reason in ``refusal`` makes a pair a refusal whatever the response says; pairs delivered or rated
again under one id count once, by the row whose texts have the smallest hash; a null id is an id of its own; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cluster import join_side, materialize
from . import crf, hyperlang

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
#: Letters from which, and the lead for each character above which, a clause's language is trusted.
FOREIGN_LETTERS = 18
FOREIGN_LEAD = 0.004
MOSTLY = 0.5
#: Bounds of the sample that the field is fitted on, and the least clauses that a sparse feature must stand in.
SAMPLE_REFUSED, SAMPLE_OPEN, SAMPLE_OTHERS = 400, 800, 1000
LEAST_SEEN = 2
#: Lead (a logarithm) from which an open response is taken for a complete one.
WHOLE = 1.0
#: Longest response, in clauses, that is fitted on.
LONGEST = 12
SEED = 5

_CITATION = re.compile(r"\[\s*\d+(?:\s*[,;–-]\s*\d+)*\s*\]")
_CUT_CITATION = re.compile(r"\s*\[\s*\d*(?:\s*,\s*\d*)*$")
_PLACEHOLDERS = frozenset("n/a na none null nil nan tbd todo undefined empty -".split())
_PREFIX = re.compile(r"^(?:[>\-–—*•#]+\s*|\(?\d{1,2}[.)]\s+|(?:q|a|question|answer|frage|antwort|pregunta|respuesta|réponse|pergunta|resposta|vraag|antwoord)\s*:\s*)+", re.I)
_CLAUSE = re.compile(r"(?<=[.!?…;])[\"'”»)\]*]*\s+|\n+")
#: How a response ends that is closed, citations and quotation marks aside; and one that ends with the mark of a list entry.
_CLOSED_END = r"[.!?…。:)][\"'”»*_\s]*(\[[\d,;\s]*\][\s.*_]*)*$"
_MARK_END = r"\n\s*\(?\d{1,2}[.)]\s*$"
_TOKEN = re.compile(r"[^\W_]+")

DENSE = ("bias", "echo", "overlap", "foreign", "open", "joined", "end_rate", "unseen_end", "bare", "brief", "after_more", "first", "last", "few_words", "words", "phrase")


def plain(text: str) -> str:
    """A text without citations, bold marks and the white space that shows nothing."""
    text = text.replace("​", "").replace("⁠", "").replace("﻿", "").replace("\xad", "")
    return _CITATION.sub("", text).replace("**", "").replace("__", "").strip()


def is_empty(text: str | None) -> bool:
    """No words but citation marks or a placeholder."""
    bare = plain(text or "")
    return not _TOKEN.search(bare) or bare.strip("()[]<>{}\"'. ").lower() in _PLACEHOLDERS


def clauses(text: str) -> list[str]:
    return [c for c in (x.strip() for x in _CLAUSE.split(plain(text))) if c]


def _folded(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


@dataclass(frozen=True)
class Ends:
    """How often a word ends a sentence or response, and how often it stands anywhere, in the sample."""

    ending: dict[str, int]
    anywhere: dict[str, int]

    def rate(self, word: str) -> float:
        return (self.ending.get(word, 0) + 0.2) / (self.anywhere.get(word, 0) + 1.0)


@dataclass(frozen=True)
class Field:
    chain: crf.Chain
    numbers: dict[str, int]
    ends: Ends


def _is_open(part: str) -> tuple[bool, bool]:
    """Whether a last clause lacks its closing mark, and whether it breaks off in a citation."""
    tail = _CUT_CITATION.sub("", part).rstrip("\"'”»*_ ")
    cut_citation = _CUT_CITATION.search(part) is not None and part.rstrip()[-1:] != "]" and "[" in part[-6:]
    return tail[-1:] not in ".!?…。:)" or cut_citation, cut_citation


def _is_bare(part: str) -> bool:
    """Whether a clause is a list mark without an entry."""
    return not _folded(_PREFIX.sub("", part)) or bool(re.fullmatch(r"\(?\d{1,2}[.)]?", part.strip()))


def clause_features(question: str, parts: list[str], foreign: list[bool], ends: Ends) -> tuple[list[list[float]], list[list[str]]]:
    """Dense and sparse features, a row of each for every clause; ``foreign`` says whether its language is surely not the question's."""
    asked = _folded(_PREFIX.sub("", plain(question)))
    known = set(asked)
    dense, sparse = [], []
    n = len(parts)
    for i, part in enumerate(parts):
        words = _folded(_PREFIX.sub("", part))
        last = i == n - 1
        open_, cut_citation = _is_open(part) if last else (False, False)
        bare = last and _is_bare(part)
        joined = open_ and (part.rstrip()[-1:] in ",(–-" or part.count("(") > part.count(")") or cut_citation)
        share = sum(w in known for w in words) / len(words) if words else 0.0
        echo = bool(asked) and len(words) >= max(3, 0.9 * len(asked)) and share >= 0.95
        end = words[-1] if words else ""
        dense.append(
            [
                1.0, float(echo), share, float(foreign[i]), float(open_), float(joined), ends.rate(end) if open_ and words else 0.0,
                float(open_ and bool(words) and end not in ends.anywhere and not end.isdigit()), float(bare), float(open_ and n == 1 and len(words) <= 5),
                float(open_ and n > 1), float(i == 0), float(last), float(len(words) <= 3), min(len(words), 12) / 12,
                float(open_ and n == 1 and share == 1.0 and not echo),
            ]
        )
        if foreign[i]:  # words of another language tell nothing about the answer
            sparse.append([])
            continue
        shapes = ["\u00a7q" if w in known else "\u00a70" if w.isdigit() else w for w in words]
        own = {*shapes, *(f"{a} {b}" for a, b in zip(["^", *shapes], shapes)), *(w[:5] + "~" for w in shapes if len(w) > 6)}
        if open_ and words:
            own.add("$" + shapes[-1])
        sparse.append(sorted(own))
    return dense, sparse


#: Tagged examples: question, clauses and a letter for each (answer, refusal, echo, foreign, unfinished).
_EXAMPLES = (
    ("How does the engine cool down?", ("The engine cools down through the outer casing.",), "a"),
    ("How does the engine cool down?", ("Water runs through it.", "A fan at the front helps."), "aa"),
    ("How does the engine cool down?", ("About 12 minutes",), "a"),
    ("How does the engine cool down?", ("The engine",), "a"),
    ("Which parts wear out?", ("Three: the belt, the pump and the rest",), "a"),
    ("Which parts wear out?", ("Yes, on page 9",), "a"),
    ("Which parts wear out?", ("The belt wears out first.", "2. The pump follows after a year."), "aa"),
    ("Which parts wear out?", ("The book does not list them in one place, but page 4 explains it.", "The belt wears out first."), "aa"),
    ("Which parts wear out?", ("I could not find a single number for this;", "the chapter gives a range instead.", "The belt lasts two years."), "aaa"),
    ("Which parts wear out?", ("Nothing is said about the price, yet the order is clear.", "The belt comes first."), "aa"),
    ("Which parts wear out?", ("Sorry for the long list.", "The belt wears out first."), "aa"),
    ("Which parts wear out?", ("There is no simple rule here.", "The belt wears out because nothing else bends."), "aa"),
    ("Which parts wear out?", ("Which parts wear out?", "The belt wears out first."), "ea"),
    ("Which parts wear out?", ("The question precedes the answer because nothing else is available.",), "a"),
    ("Which parts wear out?", ("The passage supports every text of the book without further preparation.",), "a"),
    ("Which parts wear out?", ("Which parts wear out?",), "e"),
    ("Which parts wear out?", ("which parts wear out",), "e"),
    ("Which parts wear out?", ("Which parts wear out?", "Which parts wear out?"), "ee"),
    ("How does the engine cool down?", ("How does the engine cool down",), "e"),
    ("How does the engine cool down?", ("HOW DOES THE ENGINE COOL DOWN?",), "e"),
    ("How does the engine cool down?", ("I cannot answer this question.",), "r"),
    ("How does the engine cool down?", ("Unfortunately I am unable to help.", "I'd rather not speculate about the engine."), "rr"),
    ("How does the engine cool down?", ("There is not enough information in the sources.",), "r"),
    ("How does the engine cool down?", ("None of the pages mention the engine, so I cannot tell.",), "r"),
    ("How does the engine cool down?", ("The context offers no answer to your question.",), "r"),
    ("How does the engine cool down?", ("This is not covered by the text.",), "r"),
    ("How does the engine cool down?", ("The book does not say anything about the engine.",), "r"),
    ("How does the engine cool down?", ("I could not find an answer to this in the pages.",), "r"),
    ("How does the engine cool down?", ("I must decline to answer.",), "r"),
    ("How does the engine cool down?", ("Sorry, nothing in the excerpts deals with this.",), "r"),
    ("How does the engine cool down?", ("I'd rather not speculate about the engine",), "r"),
    ("How does the engine cool down?", ("There is not enough information to answer",), "r"),
    ("Wie kühlt der Motor ab?", ("Leider steht dazu nichts im Buch.",), "r"),
    ("Wie kühlt der Motor ab?", ("Das kann ich nicht beantworten.", "Es tut mir leid."), "rr"),
    ("Wie kühlt der Motor ab?", ("Der Motor kühlt über das Gehäuse ab.",), "a"),
    ("Wie kühlt der Motor ab?", ("Nur 9 Minuten",), "a"),
    ("Wie kühlt der Motor ab?", ("Wie kühlt der Motor ab?",), "e"),
    ("Comment le moteur refroidit-il ?", ("Je ne peux pas répondre à cette question.",), "r"),
    ("Comment le moteur refroidit-il ?", ("Aucun passage ne permet de le dire.", "Désolé."), "rr"),
    ("Comment le moteur refroidit-il ?", ("Le moteur refroidit par le carter.",), "a"),
    ("¿Cómo se enfría el motor?", ("Lo siento, no puedo ayudar.",), "r"),
    ("¿Cómo se enfría el motor?", ("El libro no dice nada.",), "r"),
    ("¿Cómo se enfría el motor?", ("El motor se enfría por la carcasa.",), "a"),
    ("Como o motor esfria?", ("O livro não diz nada.",), "r"),
    ("Como o motor esfria?", ("Não posso ajudar com isso.",), "r"),
    ("Como o motor esfria?", ("O motor esfria pela carcaça.",), "a"),
    ("Hoe koelt de motor af?", ("Ik kan deze vraag niet beantwoorden.",), "r"),
    ("Hoe koelt de motor af?", ("Het boek zegt hierover niets.",), "r"),
    ("Hoe koelt de motor af?", ("De motor koelt af via het huis.",), "a"),
    ("How does the engine cool down?", ("Der Motor kühlt über das Gehäuse ab.",), "f"),
    ("How does the engine cool down?", ("Le moteur refroidit par le carter.", "L'eau y passe."), "ff"),
    ("How does the engine cool down?", ("El motor se enfría por la carcasa.", "El agua pasa por"), "fu"),
    ("Wie kühlt der Motor ab?", ("The engine cools down through the casing.", "It takes nine minutes."), "ff"),
    ("Wie kühlt der Motor ab?", ("The engine cools down through the casing",), "f"),
    ("How does the engine cool down?", ("The engine cools down through the outer casing.", "A fan at the fro"), "au"),
    ("How does the engine cool down?", ("The engine cools down through the outer casing.", "Every fan blows the"), "au"),
    ("How does the engine cool down?", ("The engine cools down through the outer casing.", "2."), "au"),
    ("How does the engine cool down?", ("The engine cools down through the outer casing.", "2. The"), "au"),
    ("How does the engine cool down?", ("The engine cools down (on page 43, the",), "u"),
    ("How does the engine cool down?", ("The engine cools down through the outer casing because nothing el",), "u"),
    ("How does the engine cool down?", ("Water runs through it.", "A fan helps.", "The pump drives the water, and"), "aau"),
    ("How does the engine cool down?", ("How does the engine cool down?", "The engine cools dow"), "eu"),
    ("Wie kühlt der Motor ab?", ("Der Motor kühlt ab.", "Das Wasser läuft durch die"), "au"),
)

#: Ways to decline, each an example of its own.
_REFUSALS = tuple(
    """I don't know. | I do not know the answer. | No idea, I am afraid. | I have no information on that. | I have nothing to say about this. | I am not able to say. | I am not sure about that.
    I cannot help you with this. | I can't provide an answer to that. | I won't answer this. | I am not allowed to discuss this. | I may not talk about that. | This is beyond what I may discuss. | That goes beyond my knowledge.
    This lies outside the scope of the book. | It is not within my knowledge. | That is outside of what I know. | It is not something I can speak about. | Please ask somebody else. | You should ask an expert about this. | You will have to look elsewhere for that.
    Nobody can say. | The sources are silent on this. | The text says nothing about it. | There is no information about that here. | The material does not cover it. | I was unable to find anything on this. | My apologies, but I have to pass on this one.
    As a language model I cannot comment on that. | I would rather not say. | That question cannot be answered from these pages. | No passage answers the question. | I must decline. | It is impossible to tell from the text. | Sorry, I can't do that.
    Das weiß ich nicht. | Dazu kann ich nichts sagen. | Dazu habe ich keine Informationen. | Die Quellen schweigen dazu. | Darüber darf ich nicht sprechen. | Bitte fragen Sie jemand anderen. | Das liegt außerhalb meines Wissens. | Tut mir leid, da kann ich nicht helfen. | Kein Kapitel gibt darüber Auskunft. | Das Buch sagt dazu nichts. | Keine Textstelle beantwortet die Frage. | Ich möchte dazu nichts vermuten. | Darauf gibt der Text keine Antwort.
    Je ne sais pas. | Je ne peux rien dire à ce sujet. | Je n'ai aucune information là-dessus. | Les sources n'en disent rien. | Cela dépasse mes connaissances. | Veuillez demander à quelqu'un d'autre. | Je préfère ne pas répondre. | Désolé, je ne peux pas vous aider. | Aucun chapitre ne permet de le dire. | Le livre ne dit rien sur ce point. | Aucune page ne répond à la question. | Le texte ne permet pas de répondre. | Il m'est impossible de répondre.
    No lo sé. | No tengo información sobre eso. | No puedo decir nada al respecto. | Las fuentes no dicen nada sobre ello. | Eso está fuera de mi conocimiento. | Pregunte a otra persona. | Prefiero no responder. | Lo siento, no puedo contestar. | Ningún capítulo permite decirlo. | El libro no dice nada sobre este punto. | Ninguna parte del texto permite responder. | El texto no contesta la pregunta. | Me es imposible contestar.
    Não sei. | Não tenho informações sobre isso. | Não posso dizer nada a respeito. | As fontes nada dizem sobre isso. | Isso está fora do meu conhecimento. | Pergunte a outra pessoa. | Prefiro não responder. | Desculpe, não posso ajudar. | Nenhum capítulo permite dizer isso. | O livro não diz nada sobre este ponto. | Nenhuma parte do texto permite responder. | O texto não responde à pergunta. | É impossível responder.
    Dat weet ik niet. | Daar kan ik niets over zeggen. | Ik heb daar geen informatie over. | De bronnen zeggen er niets over. | Dat valt buiten mijn kennis. | Vraag het aan iemand anders. | Ik geef daar liever geen antwoord op. | Sorry, daar kan ik niet mee helpen. | Geen enkel hoofdstuk geeft daar antwoord op. | Het boek vertelt er niets over. | Geen enkele bladzijde beantwoordt de vraag. | De tekst geeft geen antwoord. | Het boek zegt daar niets van.""".replace("\n", "|").split("|")
)


#: Ways to answer, each an example of its own.
_ANSWERS = tuple(
    """They meet twice a year. | It takes about nine minutes. | He wrote the book in 1912. | She calls it the second law. | You turn the key and wait. | We use it to store water. | This is done by hand. | That depends on the size of the pump.
    Because the water is cold. | In the third chapter, on page 40. | The author says that it began in May. | Nobody lived there before the war. | There are three kinds of belts. | The text compares both engines. | Most people keep it in a dry place. | I found the number in the second table.
    An answer to the question came from a monk. | It does not rust, as there is no iron in it. | The pump cannot run dry, so a valve closes it. | Sorry to say, the first two engines burned down. | Nothing happens until the valve opens. | The sources of the river lie in the hills. | The question was settled by a vote.
    One can help the plant with some shade. | Something is kept for the winter. | Everyone may take a part of it. | The book tells how the town was built. | Page 12 shows the parts. | Both are needed. | First comes the belt, then the pump. | Its colour changes with the heat. | People act together and share what they have.
    Das dauert neun Minuten. | Sie treffen sich zweimal im Jahr. | Nichts geschieht, bis sich das Ventil öffnet. | Das Buch beschreibt drei Arten. | Weil das Wasser kalt ist. | Im dritten Kapitel steht die Tabelle.
    Cela prend neuf minutes. | Ils se retrouvent deux fois par an. | Le livre décrit trois sortes. | Parce que l'eau est froide. | Rien ne bouge avant l'ouverture de la vanne. | Le tableau se trouve au chapitre trois.
    Tarda nueve minutos. | Se reúnen dos veces al año. | El libro describe tres clases. | Porque el agua está fría. | Nada se mueve hasta que se abre la válvula. | La tabla está en el capítulo tres.
    Demora nove minutos. | Encontram-se duas vezes por ano. | O livro descreve três tipos. | Porque a água está fria. | Nada se move até a válvula abrir. | A tabela está no capítulo três.
    Dat duurt negen minuten. | Zij komen twee keer per jaar bijeen. | Het boek beschrijft drie soorten. | Omdat het water koud is. | Er gebeurt niets tot de klep opengaat. | De tabel staat in hoofdstuk drie.""".replace("\n", "|").split("|")
)


def _number(sparse: list[list[str]], numbers: dict[str, int]) -> list[list[int]]:
    return [[numbers[f] for f in own if f in numbers] for own in sparse]


def _rows(sequences: list, ends: Ends, numbers: dict[str, int] | None) -> tuple[crf.Rows, dict[str, int]]:
    """Features of sequences that begin with question, clauses and foreign flags; the numbers of the sparse ones are made where not given."""
    both = [clause_features(*s[:3], ends) for s in sequences]
    sparse = [own for _, w in both for own in w]
    if numbers is None:
        seen = Counter(f for own in sparse for f in own)
        numbers = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= LEAST_SEEN))}
    return crf.Rows(np.array([row for d, _ in both for row in d]), _number(sparse, numbers)), numbers


def _fit(sequences: list, ends: Ends, numbers: dict[str, int] | None = None, begin: crf.Chain | None = None, rounds: int = 80) -> Field:
    rows, numbers = _rows(sequences, ends, numbers)
    lengths, tags = [len(s[1]) for s in sequences], [t for s in sequences for t in s[3]]
    # words tell a refusal from the rest; whether a clause is finished is told by its end
    shared = np.array([i for f, i in numbers.items() if f[0] != "$"], dtype=np.int64)
    return Field(crf.fit(rows, lengths, tags, TAGS, max(1, len(numbers)), rounds, begin=begin, quiet=(2, 3), together=(0, 4), shared=shared), numbers, ends)


def _looks_whole(open_: list, cuts: list, ends: Ends) -> list[float]:
    """How much likelier each open response is among the open responses of the sample than among responses cut at random, as a
    logarithm: high where it is a kind of its own (a short complete answer), low where it looks like any other cut."""
    last = lambda s: (s[0], s[1][-1:], s[2][-1:])
    alone = lambda s: 1.0 if len(s[1]) == 1 else 0.0
    both = [*open_, *cuts]
    rows, numbers = _rows([last(s) for s in both], ends, None)
    dense = np.concatenate([rows.dense, np.array([[alone(s), alone(s) * (len(s[1][-1].split()) <= 5)] for s in both])], axis=1)
    rows = crf.Rows(dense, rows.sparse)
    tags = [0] * len(open_) + [1] * len(cuts)
    chain = crf.fit(rows, [1] * len(both), tags, ("given", "cut"), max(1, len(numbers)), rounds=60, sparse_decay=1.0)
    e = crf.scores(chain, rows)[: len(open_)] + chain.start
    return (e[:, 0] - e[:, 1] - np.log(len(open_) / len(cuts))).tolist()


def tag(field: Field, question: str, parts: list[str], foreign: list[bool]) -> list[int]:
    """The tags of one response."""
    dense, sparse = clause_features(question, parts, foreign, field.ends)
    e = crf.scores(field.chain, crf.Rows(np.array(dense), _number(sparse, field.numbers)))
    return crf.decode(e, [len(parts)], field.chain).tolist()


def _by_hand() -> list[tuple[str, list[str], list[bool], list[int]]]:
    tagged = [(q, list(parts), [t == "f" for t in tags], ["arefu".index(t) for t in tags]) for q, parts, tags in _EXAMPLES]
    refused = [(_EXAMPLES[0][0], [r.strip()], [False], [1]) for r in _REFUSALS]
    answered = [(_EXAMPLES[0][0], [r.strip()], [False], [0]) for r in _ANSWERS]
    return [*tagged * 3, *refused * 2, *answered * 2]


def train(sample: list[tuple[str, list[str], list[bool], bool]] = ()) -> Field:
    """The field, from the examples and a sample of responses: question, clauses, whether each is foreign, and whether a reason for
    a refusal is given."""
    sample = [(q, parts[:LONGEST], foreign[:LONGEST], told) for q, parts, foreign, told in sample if parts]
    texts = [p for _, parts, _, _ in sample for p in parts] + [p for _, parts, _ in _EXAMPLES for p in parts]
    ending, anywhere = Counter(), Counter()
    for part in texts:
        words = _folded(_PREFIX.sub("", part))
        anywhere.update(words)
        ending.update(words[-1:])
    ends = Ends(dict(ending), dict(anywhere))
    rng = random.Random(SEED)
    sure, cuts, open_, unsure = _by_hand(), [], [], []
    for question, parts, foreign, told in sample:
        if told:
            sure.append((question, parts, foreign, [1] * len(parts)))
        elif _is_open(parts[-1])[0] or _is_bare(parts[-1]):
            open_.append((question, parts, foreign))
        elif len(parts) >= 3:
            dense, _ = clause_features(question, parts, foreign, ends)
            y = [3 if f else 2 if d[1] else 0 for f, d in zip(foreign, dense)]
            sure.append((question, parts, foreign, y))
            keep = rng.randrange(1, len(parts) + 1)
            whole = parts[keep - 1]
            cut = whole[: rng.randrange(1, max(2, len(whole) - 1))].rstrip()
            if rng.random() < 0.3:
                cut = cut.rpartition(" ")[0] or cut
            if keep > 1 and rng.random() < 0.15:
                cut = f"{keep}."  # a list breaks off after the mark of an entry
            if cut and (_is_open(cut)[0] or _is_bare(cut)):
                cuts.append((question, [*parts[: keep - 1], cut], foreign[:keep], [*y[: keep - 1], 3 if foreign[keep - 1] and keep == 1 else 4]))
        else:
            unsure.append((question, parts, foreign))
    if open_ and cuts:
        for (question, parts, foreign), lead in zip(open_, _looks_whole(open_, cuts, ends)):
            dense, _ = clause_features(question, parts, foreign, ends)
            y = [3 if f else 2 if d[1] else 0 for f, d in zip(foreign, dense)]
            broken = dense[-1][DENSE.index("joined")] or dense[-1][DENSE.index("bare")]  # an open bracket, a comma, a mark alone
            if broken or any(t != 2 for t in y[:-1]):  # what goes before was closed, so this would have been
                sure.append((question, parts, foreign, [*y[:-1], 4]))
            elif lead > WHOLE:
                sure.append((question, parts, foreign, y))
            else:
                unsure.append((question, parts, foreign))
    sure += [c for c in cuts if len(c[1]) > 1 or len(c[1][0].split()) > 3]
    _, numbers = _rows([*sure, *unsure], ends, None)
    first = _fit(sure, ends, numbers)
    if not unsure:
        return first
    return _fit([*sure, *((q, parts, foreign, tag(first, q, parts, foreign)) for q, parts, foreign in unsure)], ends, numbers, first.chain, 40)


def _languages(profiles: hyperlang.Profiles, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Best language of each text and whether it is sure."""
    if not texts or len(profiles.languages) < 2:
        return np.zeros(len(texts), dtype=int), np.zeros(len(texts), dtype=bool)
    sym = hyperlang.symbols(hyperlang.points("\n\n\n".join(texts) + "\n\n\n"))
    lengths = np.array([len(t) + 3 for t in texts])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    scores = hyperlang.score_spans(profiles, sym, starts)
    letters = np.add.reduceat((sym > 0).astype(np.int32), starts)
    two = np.partition(scores, -2, axis=1)[:, -2:]
    sure = (letters >= FOREIGN_LETTERS) & (two[:, 1] - two[:, 0] >= FOREIGN_LEAD * letters)
    return scores.argmax(axis=1), sure


def _defect(parts: list[str], tags: list[int]) -> str | None:
    cover = [0.0] * len(TAGS)
    for part, tag in zip(parts, tags):
        cover[tag] += max(1, sum(map(len, _TOKEN.findall(part))))
    total = sum(cover)
    if cover[1] and not cover[0] and not cover[3] and not cover[4]:
        return "refusal"
    if cover[2] == total:
        return "copy"
    spoken = total - cover[2]
    if cover[3] > MOSTLY * spoken:
        return "language"
    return "truncated" if tags[-1] == 4 else None


def _analyse(profiles: hyperlang.Profiles, asked: list[str], given: list[str | None]) -> tuple[list[list[str]], list[list[bool]]]:
    """Clauses of each response, and whether each is surely in another language than its question."""
    parts = [[] if is_empty(g) else clauses(g) for g in given]
    q_lang, q_sure = _languages(profiles, asked)
    c_lang, c_sure = _languages(profiles, [p for ps in parts for p in ps])
    foreign, k = [], 0
    for i, ps in enumerate(parts):
        foreign.append([bool(q_sure[i] and c_sure[k + j] and c_lang[k + j] != q_lang[i]) for j in range(len(ps))])
        k += len(ps)
    return parts, foreign


def _told(reason: str | None) -> bool:
    return bool(reason and reason.strip())


def fit_sample(pairs: DataFrame, profiles: hyperlang.Profiles) -> Field:
    """The field, with a bounded sample of ``question, given, refusal``."""
    told = F.length(F.trim(F.coalesce("refusal", F.lit("")))) > 0
    kind = F.when(told, 0).when(F.rlike("given", F.lit(_CLOSED_END)) & ~F.rlike("given", F.lit(_MARK_END)), 2).otherwise(1)
    some = pairs.filter(F.length("given") > 0).select("question", "given", kind.alias("kind"), F.xxhash64("question", "given", F.lit(SEED)).alias("order"))
    bounds = (SAMPLE_REFUSED, SAMPLE_OPEN, SAMPLE_OTHERS)
    picked = [some.filter(F.col("kind") == k).orderBy("order", "question", "given").limit(n) for k, n in enumerate(bounds)]
    rows = sorted(picked[0].unionByName(picked[1]).unionByName(picked[2]).collect(), key=lambda r: (r.kind, r.order, r.given))
    asked = [r.question or "" for r in rows]
    parts, foreign = _analyse(profiles, asked, [r.given for r in rows])
    return train([(q, p, f, r.kind == 0) for q, p, f, r in zip(asked, parts, foreign, rows)])


def tag_pairs(pairs: DataFrame, profiles: hyperlang.Profiles, field: Field) -> DataFrame:
    """``id, question, given, refusal`` in; ``id, defect, clauses, tags`` out, one row for each row, defect null where sound."""
    shared = pairs.sparkSession.sparkContext.broadcast((profiles, field))
    kind = pairs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        profiles, field = shared.value
        for whole in batches:
            for at in range(0, len(whole), 2000):
                b = whole.iloc[at : at + 2000]
                asked = [q or "" for q in b["question"]]
                parts, foreign = _analyse(profiles, asked, list(b["given"]))
                dense, sparse = [], []
                for q, ps, f in zip(asked, parts, foreign):
                    if ps:
                        d, w = clause_features(q, ps, f, field.ends)
                        dense += d
                        sparse += _number(w, field.numbers)
                sizes = [len(ps) for ps in parts]
                flat = crf.decode(crf.scores(field.chain, crf.Rows(np.array(dense), sparse)), sizes, field.chain).tolist() if dense else []
                defects, tags, k = [], [], 0
                for ps, reason in zip(parts, b["refusal"]):
                    path = flat[k : k + len(ps)]
                    k += len(ps)
                    tags.append([TAGS[t] for t in path])
                    defects.append("refusal" if _told(reason) else "empty" if not ps else _defect(ps, path))
                yield pd.DataFrame({"id": b["id"].to_numpy(), "defect": defects, "clauses": parts, "tags": tags})

    return pairs.select("id", "question", "given", "refusal").mapInPandas(run, f"id {kind}, defect string, clauses array<string>, tags array<string>")


def distinct_items(review_items: DataFrame, id_col: str = "answer_id") -> DataFrame:
    """``id, question, given, refusal`` of each id once.

    Which row of an id counts is settled by hashes of its texts; only the texts of ids with several different rows are shuffled."""
    rows = review_items.select(F.col(id_col).alias("id"), "question", "given", "refusal")
    again = join_side(rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("again")))
    same = rows["id"].eqNullSafe(again["again"])
    texts = F.struct(F.xxhash64("question", "given", "refusal").alias("order"), "question", "given", "refusal")
    several = rows.join(again, same, "left_semi").groupBy("id").agg(F.min(texts).alias("t")).select("id", "t.question", "t.given", "t.refusal")
    return rows.join(again, same, "left_anti").unionByName(several)


def defective_pairs(review_items: DataFrame, questions: DataFrame, profiles: hyperlang.Profiles) -> DataFrame:
    """``item_table, item_id, defect`` of both tables; an unanswerable question is answered rightly by declining."""
    field = fit_sample(review_items, profiles)
    rated = tag_pairs(distinct_items(review_items), profiles, field).select(F.lit("review_items").alias("item_table"), F.col("id").alias("item_id"), "defect")
    asked = questions.select(F.struct("qid", "kind").alias("id"), "question", F.col("answer").alias("given"), F.lit(None).cast("string").alias("refusal")).dropDuplicates(["id"])
    labelled = tag_pairs(asked, profiles, field).select(F.lit("questions").alias("item_table"), F.col("id.qid").alias("item_id"), "defect", F.col("id.kind").alias("kind"))
    sound = (F.col("kind") == "unanswerable") & (F.col("defect") == "refusal")
    labelled = labelled.filter(~F.coalesce(sound, F.lit(False))).drop("kind")
    return rated.unionByName(labelled).filter(F.col("defect").isNotNull())
