"""Useless replies to questions, found by weak labelling functions and a label model for each defect.

Every defect has some noisy functions that vote for it, against it or not at all. An expectation-maximization label model
learns, from how often the votes of a defect agree, how far each function can be trusted, and turns each pattern of votes into a
posterior. The cutoff of a defect is the one with the best expected F1 on rows that the model wasn't fitted to.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.session import materialize
from chronotext.skew import salted_join

#: Three-character sequences that a language's questions must have to be told by, characters of a text to be judged, and by how much the mean
#: logarithm of the likelihood of another language must be above.
ENOUGH, SHORTEST, CLEAR = 2_000, 30, 0.25
#: In the order in which they are told where one defect is asked for.
DEFECTS = ("empty", "refusal", "copy", "language", "truncated")

# Words, phrases and marks.
LABEL = r"(?:answer|response|reply|question|q|a|you asked|antwort|frage|r\u00e9ponse|question|respuesta|pregunta|risposta|domanda|resposta|pergunta)"
PLACEHOLDER = re.compile(r"(?:null|none|nil|nan|n ?/? ?a|tbd|tba|todo|undefined|unknown|placeholder|no answer|empty|blank|missing|lorem ipsum|x+)", re.I)
YES_NO = set("yes no yep nope yeah oui non ja nein s\u00ed si sim n\u00e3o nao da net \u0434\u0430 \u043d\u0435\u0442 \u306f\u3044 \u3044\u3044\u3048 \u662f \u4e0d\u662f tak nie nee correct true false".split())
UNABLE = re.compile(
    r"\b(?:cannot|can'?t|can not|could not|couldn'?t|unable to|not able to|won'?t be able to|wouldn'?t be able to|not in a position to|(?:not |im)possible (?:for me )?to|no way (?:for me )?to)\s+(?:\w+\s+){0,3}?(?:answer|help|assist|tell|say|rul(?:e|ing)|determin\w+|decid\w+|provide|give|comment|respond|be determined)\b"
    r"|\bbeyond (?:my|what i)\b|\boutside (?:of )?(?:what|my|the scope)\b", re.I)
UNINFORMED = re.compile(
    r"\b(?:passages?|context|sources?|documents?|excerpts?)\b[^.:;]{0,40}\b(?:do(?:es)? not|don'?t|doesn'?t|no|never|lack)\b[^.:;,]{0,40}\b(?:answer|information|cover|say|help|enough)\b"
    r"|\b(?:insufficient|not enough|no relevant|too little)\s+(?:context|information|passages?|detail)|\bcannot be (?:determined|answered|decided|known)|\bno answer (?:is|can be) (?:given|found|offered)"
    r"|\b(?:i|we) (?:do not|don'?t|really don'?t) (?:really )?know\b", re.I)
UNWILLING = re.compile(
    r"\b(?:must|have to|will|i) decline to\b|\bprefer not to\b|\brather not\b|\b(?:don'?t|do not) feel comfortable\b|\bno (?:comment|ruling (?:can|will|is))\b|\binstructions (?:keep|prevent|forbid|do not allow)"
    r"|\bas an? (?:ai|language model|assistant)\b|\bnot allowed to (?:answer|discuss|rule|say)|\bwhat i'?m allowed\b|\brefuse to (?:answer|rule|comment|say)|\b(?:have to|must|will|'ll) (?:pass on|skip) (?:this|that)|\bagainst my (?:guidelines|policy|policies|rules|instructions|programming)", re.I)
ELSEWHERE = re.compile(r"\b(?:please )?(?:consult|ask|contact|refer to|look at|check)\b[^.]{0,40}\b(?:judge|rulebook|staff|official|officials)\b|\bmatter for (?:the|a) (?:head )?judge", re.I)
FOREIGN_REFUSAL = re.compile(
    r"\bno puedo (?:responder|contestar|ayudar|decir|opinar|dar)|\bno contienen la respuesta|\bprefiero no\b|\b(?:no me es posible|me es imposible)\b|\bmejor no\b|\bno s\u00e9\b|\bmodelo de (?:lenguaje|linguagem)"
    r"|\bne (?:peux|puis|pouvons) pas (?:r\u00e9pondre|aider|dire|donner)|\bne permettent pas\b|\bmod\u00e8le de langage|\bje ne sais pas|\b(?:m'est|il est) impossible de\b|\bje pr\u00e9f\u00e8re ne pas"
    r"|\bnichts sagen\b|\bnicht (?:beantworten|sagen|helfen|entscheiden)\b|\bwei\u00df (?:ich|es) nicht|\bsprachmodell\b|\bmir nicht möglich\b|\blieber nicht\b|\bkeine (?:auskunft|antwort|angabe)"
    r"|\bn\u00e3o (?:posso|sei|consigo) ?(?:responder|ajudar|dizer)?|\bprefiro n\u00e3o|\bnon (?:posso|so|sono in grado)\b|\bpreferisco non\b"
    r"|\u043d\u0435 \u043c\u043e\u0433\u0443 (?:\u043e\u0442\u0432\u0435\u0442|\u043f\u043e\u043c\u043e\u0447)|\u043d\u0435 \u0437\u043d\u0430\u044e|\u304a\u7b54\u3048\u3067\u304d\u307e\u305b\u3093|\u308f\u304b\u308a\u307e\u305b\u3093|\u65e0\u6cd5\u56de\u7b54", re.I)
APOLOGY = re.compile(r"^\W*(?:i'?m |i am |we are )?(?:very |so )?(?:sorry|apologies|my apologies|unfortunately|regrettably|lo siento|d\u00e9sol\u00e9e?|tut mir leid|leider|desculpe|lamento|mi dispiace)\b", re.I)
FUNCTION_WORDS = {
    "en": "the a an is are was were be been of to and or in on at it its he she they you your i my we this that these those with for from by as not does do did can may will would if when then than but only any each which who what how before after",
    "de": "der die das den dem des ein eine einen einem einer und oder ist sind war wird werden kann darf muss nicht nach vor bei mit von zu im am auf aus wenn weil dass ich du er sie es mein dein sich noch nur dann als f\u00fcr \u00fcber unter durch dieser diese nein was wer wie obwohl",
    "fr": "le la les l un une des du de d et ou est sont \u00e9tait \u00eatre ne pas que qui quand si dans sur au aux avec pour par plus ce cette il elle je tu nous vous mon son sa ses se son o\u00f9 avant apr\u00e8s puis donc tant alors peut non oui",
    "es": "el la los las un una unos de del y o es son era ser no que qui\u00e9n cuando si en sobre al con para por m\u00e1s este esta su sus se yo mi tu le lo ya otra vez antes despu\u00e9s porque hasta primero puede debe aunque siga quien seg\u00fan",
    "it": "il lo la i gli le un una uno di del della dei e o \u00e8 sono era non che chi quando se in su al con per da pi\u00f9 questo questa suo sua si io mio tu prima dopo perch\u00e9 finch\u00e9 pu\u00f2 deve ancora poi solo secondo alla nella ha",
    "pt": "o a os as um uma de do da dos das e ou \u00e9 s\u00e3o era n\u00e3o que quem quando se em no na nos nas ao com para por mais este esta seu sua eu meu antes depois porque at\u00e9 pode deve ainda s\u00f3 enquanto foi fica segundo",
    "nl": "de het een en of is zijn was niet dat die wie wanneer als in op aan met voor van door meer deze dit hij zij ik mijn jij maar kan mag moet naar nog dan bij uit",
    "pl": "i w na z do nie \u017ce jest s\u0105 by\u0142 kto kiedy je\u015bli przed po przez dla od jak tak ale mo\u017ce musi si\u0119 tego ten ta to",
}
SCRIPTS = {"ru": "\u0400-\u04ff", "ja": "\u3040-\u30ff", "zh": "\u4e00-\u9fff", "ko": "\uac00-\ud7af", "el": "\u0370-\u03ff", "ar": "\u0600-\u06ff", "he": "\u0590-\u05ff", "hi": "\u0900-\u097f", "th": "\u0e00-\u0e7f"}

# Words without one of which none of the phrases above can stand in a text; what is not told by words stands apart.
TRIGGERS = {
    UNABLE: "cannot can't cant couldn't couldnt unable won't wouldn't impossible way beyond outside not",
    UNINFORMED: "passage passages context source sources document documents excerpt excerpts insufficient enough relevant little cannot answer know",
    UNWILLING: "decline prefer rather comfortable comment ruling instructions ai language assistant allowed refuse pass skip against",
    ELSEWHERE: "consult ask contact refer look check matter",
    FOREIGN_REFUSAL: "puedo contienen prefiero posible imposible mejor s\u00e9 modelo peux puis pouvons permettent mod\u00e8le sais impossible pr\u00e9f\u00e8re nichts nicht wei\u00df sprachmodell m\u00f6glich lieber keine n\u00e3o non",
}
WORDLESS = ("\u043d\u0435", "\u304a\u7b54\u3048", "\u308f\u304b\u308a\u307e\u305b\u3093", "\u65e0\u6cd5")

_CUES = [(cue, frozenset(words.split())) for cue, words in TRIGGERS.items()]
_BY_LANGUAGE = {language: frozenset(words.split()) for language, words in FUNCTION_WORDS.items()}
_LANGUAGES: dict[str, list[str]] = {}
for _language, _words in FUNCTION_WORDS.items():
    for _word in set(_words.split()):
        _LANGUAGES.setdefault(_word, []).append(_language)
_SCRIPT = {language: re.compile(f"[{chars}]") for language, chars in SCRIPTS.items()}
_TAG, _WORD = re.compile(r"<[^<>]*>"), re.compile(r"[^\W_]+(?:['\u2019][^\W_]+)*")
_LABELS = re.compile(rf"(?:^|(?<=[\s>*_#]))[>*_#\s]*{LABEL}\s*[:\uff1a][*_]*", re.I)
_CITATION = re.compile(r"[\s(]*(?:see\s*)?\[[^\[\]]*\][.)\s]*$", re.I)
_SENTENCE = re.compile(r"(?<=[.!?\u3002\uff01\uff1f])[\"')\]*_]*\s+|\n+|(?<=[\u3002\uff01\uff1f])")
_END = re.compile(r"[.!?\u2026\u3002\uff01\uff1f][\"'\u201d\u2019\u00bb)\]*_`\s]*$")
_UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")


def _plain(text: str) -> str:
    """Lower case, without tags, entities and unseen characters."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _UNSEEN.sub("", text).replace("\u2019", "'")
    return text.lower()


def _script(text: str) -> str | None:
    """The language of a script of its own that makes up a good part of the letters."""
    if text.isascii():
        return None
    letters = max(1, sum(map(str.isalpha, text)))
    for language, script in _SCRIPT.items():
        if len(script.findall(text)) > 0.3 * letters:
            return "ja" if language == "zh" and _SCRIPT["ja"].search(text) else language
    return None


def _language(words: list[str], text: str) -> tuple[str | None, float]:
    """The most likely language and its evidence."""
    if language := _script(text):
        return language, float(len(text))
    score: dict[str, float] = {}
    for word in words:
        for part in word.split("'") if "'" in word else (word,):
            if known := _LANGUAGES.get(part):
                share = 1 / len(known)
                for language in known:
                    score[language] = score.get(language, 0.0) + share
    if not score:
        return None, 0.0
    best = max(score, key=score.__getitem__)
    n = score.pop(best)
    return (best, n) if n > max(score.values(), default=0.0) else (None, 0.0)


def _edit_share(a: str, b: str) -> float:
    """Levenshtein's distance over the longer length.

    The columns of the distance table are bit vectors of differences, so a column costs a few operations on whole numbers, however long
    the texts are.
    """
    if not a or not b:
        return 1.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    rises, falls, distance = every, 0, len(a)
    for c in b:
        same = places.get(c, 0)
        level = (((same & rises) + rises) ^ rises) | same
        up, down = falls | (every & ~(level | rises)), rises & level
        distance += bool(up & last) - bool(down & last)
        up, down = up << 1 | 1, down << 1
        rises, falls = (down | ~(same | falls | up)) & every, up & (same | falls) & every
    return distance / max(len(a), len(b))


def _asked(question: str) -> tuple[list[str], frozenset[str], str | None, float]:
    """The words of a question, their set, its language and the evidence for that. A question is asked many times; long ones aren't remembered."""
    return _remembered(question) if len(question) <= 1_000 else _remembered.__wrapped__(question)


@lru_cache(maxsize=8_192)
def _remembered(question: str) -> tuple[list[str], frozenset[str], str | None, float]:
    plain = _plain(question)
    words = _WORD.findall(plain)
    return words, frozenset(words), *_language(words, plain)


def _trigrams(bare: str) -> list[str]:
    padded = f" {bare} "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


class Profiles:
    """How often each sequence of three characters stands in the questions of each language: a guess that needs no words known beforehand.

    ``counts`` has (language, sequence, number). Languages with fewer than ENOUGH sequences are left out.
    """

    def __init__(self, counts: list[tuple[str, str, int]]):
        totals: Counter[str] = Counter()
        for language, _, n in counts:
            totals[language] += n
        self.languages = sorted(language for language, n in totals.items() if n >= ENOUGH)
        column = {language: i for i, language in enumerate(self.languages)}
        self.place: dict[str, int] = {}
        for language, gram, _ in counts:
            if language in column:
                self.place.setdefault(gram, len(self.place))
        table = np.full((len(self.place) + 1, len(self.languages)), 0.5)
        for language, gram, n in counts:
            if language in column:
                table[self.place[gram], column[language]] += n
        # The last row is for what no question has.
        self.table = np.log(table / table.sum(0)).astype(np.float32) if self.languages else table

    def speaks(self, bare: str, language: str | None) -> int | None:
        """Whether a text of plain words is likelier another language than ``language`` (1) or not (0); None if that is open."""
        if language not in self.languages or len(bare) < SHORTEST:
            return None
        unknown, place = len(self.place), self.place
        mean = self.table[[place.get(g, unknown) for g in _trigrams(bare)]].mean(0)
        own = float(mean[self.languages.index(language)])
        best = float(mean.max())
        return 1 if best > own + CLEAR else (0 if own >= best else None)


def profiles(rulings: DataFrame) -> Profiles:
    """``Profiles`` of all questions whose function words tell their language clearly; the table grows with alphabets, not with rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: Counter[tuple[str, str]] = Counter()
            for question in batch["question"]:
                words, _, language, evidence = _asked(question)
                if language in FUNCTION_WORDS and evidence >= 3:
                    counts.update((language, g) for g in _trigrams(" ".join(words)))
            yield pd.DataFrame([(language, g, n) for (language, g), n in counts.items()], columns=["language", "gram", "n"])

    asked = rulings.select("question").where("question IS NOT NULL")
    counted = asked.mapInPandas(run, "language string, gram string, n bigint").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    return Profiles([tuple(r) for r in counted.collect()])


def votes(text: str | None, done_reason: str | None, question: str | None, known_languages: Profiles | None = None) -> dict[str, list[int | None]]:
    """For each defect what its functions say: 1 for, 0 against, None nothing."""
    plain = _plain(text or "")
    body = _LABELS.sub(" ", plain) if ":" in plain or "\uff1a" in plain else plain
    words = _WORD.findall(body)
    bare = " ".join(words)
    brief = bool(words) and len(words) < 40 and all(w in YES_NO or w in ("once", "please") for w in words)
    out: dict[str, list[int | None]] = {}

    # Placeholders have three words at most. Apart from their list, so few letters seldom say anything.
    letters = sum(map(len, words))
    placeholder = len(words) <= 4 and (bool(PLACEHOLDER.fullmatch(bare)) or bool(PLACEHOLDER.fullmatch(body.strip(" \t\r\n()[]<>\"'.`*-_"))))
    out["empty"] = [int(not words or placeholder), None if brief or 12 <= letters <= 30 else int(letters < 12), 0 if brief or len(words) > 4 else None, 1 if text is None or not text.strip() else None]

    # What remains without the question's words shows whether anything is answered.
    asked, asked_words, theirs, evidence = _asked(question) if question and question.strip() else ([], frozenset(), None, 0.0)
    known = bool(asked)
    left = list(words)
    if known and asked[0] in words:
        left, at, n = [], 0, len(asked)
        while at < len(words):
            if words[at] == asked[0] and words[at : at + n] == asked:
                at += n
            else:
                left.append(words[at])
                at += 1
    told = set(words)
    told.update(part for w in words if "'" in w for part in w.split("'"))
    wordless = not body.isascii() and any(x in body for x in WORDLESS)
    hits = [1 if (not told.isdisjoint(triggers) or wordless and cue is FOREIGN_REFUSAL) and cue.search(body) else None for cue, triggers in _CUES]
    any_hit = any(hits)
    sentences = [(s, own) for s in _SENTENCE.split(body) if s and (own := _WORD.findall(s))]
    rest = 0
    for s, own in sentences:
        if any_hit and (any(hit and cue.search(s) for hit, (cue, _) in zip(hits, _CUES)) or APOLOGY.search(s) and len(own) <= 6):
            continue
        # A question answers nothing.
        if "?" in s[-3:]:
            continue
        if known and len(set(own) - asked_words) <= max(1, len(own) // 5):
            continue
        rest += len(own)
    out["refusal"] = [*hits, (1 if any_hit and rest <= 3 else 0), (1 if any_hit and APOLOGY.search(body) else None), 0 if rest >= 6 or not words or brief else None]

    extra = [w for w in words if w not in asked_words]
    same = set(words) & asked_words
    if not known or not words:
        out["copy"] = [None] * 5
    else:
        cover = len(same) / len(asked_words)
        share = len(same) / len(asked_words.union(words))
        wanted = " ".join(asked)
        near = _edit_share(bare, wanted) if share >= 0.4 and len(bare) <= 1.6 * len(wanted) else 1.0
        twice = len(left) <= 2 and len(words) > len(left)
        out["copy"] = [int(share >= 0.72), int(cover >= 0.7 and len(extra) <= 3), 1 if near <= 0.2 else (0 if near > 0.45 and not twice else None), 1 if twice else None, 0 if len(extra) >= 5 or cover < 0.5 else None]

    if not known or not words or brief:
        out["language"] = [None] * 4
    else:
        own_words = left or words
        mine, sure = _language(own_words, body)
        at_home = _BY_LANGUAGE.get(theirs, frozenset())
        home = sum(w in at_home for w in own_words) / len(own_words)
        foreign = _script(body)
        out["language"] = [
            None if not theirs or not mine or evidence < 1 or sure < 1 else int(mine != theirs),
            # Where the question's own function words are many, sequences would say the same again.
            known_languages.speaks(" ".join(filter(str.isalpha, own_words)), theirs) if known_languages and home <= 0.2 else None,
            None if theirs not in FUNCTION_WORDS or len(own_words) < 5 else (1 if home < 0.1 else (0 if home > 0.2 else None)),
            None if not theirs else (int(foreign != theirs) if foreign or theirs in _SCRIPT else None),
        ]

    tail = plain.rstrip(" \t\r\n*_`")
    kept = tail
    while kept and (cut := _CITATION.sub("", kept)) != kept and _END.search(cut.rstrip()):
        kept = cut.rstrip()
    ends = bool(_END.search(kept)) or not words
    open_left = any(tail.count(a) > tail.count(b) for a, b in (("[", "]"), ("(", ")")))
    last = tail.rsplit(None, 1)[-1] if tail.strip() else ""
    joiner = last.strip("\"'") in _LANGUAGES or last.endswith((",", "-", ";", "@", "["))
    spoilt = not words or placeholder or brief
    out["truncated"] = [
        0 if spoilt else int(not ends), 0 if spoilt else int(tail[-1:].isalnum() or tail.endswith((",", ";", ":", "-", "[", "("))), 1 if open_left and not spoilt else None,
        None if spoilt else (1 if joiner and not ends else None), 1 if done_reason == "length" else None,
    ]
    return out


def fit(patterns: dict[str, int], steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Prior and rates of a two-class label model by EM over counted vote patterns ('1', '0', '-' for each function).

    Returns (prior, 2 x functions matrix of the chance of a vote for the defect, given its absence and presence, among the
    votes cast). Weak priors keep the rates inside (0, 1) and the presence on the side of the votes for it.
    """
    keys = list(patterns)
    counts = np.array([patterns[k] for k in keys], float)
    cast = np.array([[c != "-" for c in k] for k in keys], float)
    yes = np.array([[c == "1" for c in k] for k in keys], float)
    prior, rate = np.array([0.95, 0.05]), np.tile([[0.03], [0.9]], (1, yes.shape[1]))
    for _ in range(steps):
        p = _posterior(prior, rate, cast, yes)
        weight = np.stack([1 - p, p]) * counts
        prior = (weight.sum(1) + [2, 1]) / (counts.sum() + 3)
        # Pseudo-votes: 1 for 40 without, and 8 for 10 with the defect.
        new = (weight @ yes + [[1], [8]]) / (weight @ cast + [[40], [10]])
        if np.abs(new - rate).max() < 1e-9:
            break
        rate = new
    return prior, rate


def _posterior(prior: np.ndarray, rate: np.ndarray, cast: np.ndarray, yes: np.ndarray) -> np.ndarray:
    log = np.log(prior)[:, None] + np.log(rate) @ yes.T + np.log(1 - rate) @ (cast - yes).T
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def posterior(prior: np.ndarray, rate: np.ndarray, keys: list[str]) -> np.ndarray:
    cast = np.array([[c != "-" for c in k] for k in keys], float)
    yes = np.array([[c == "1" for c in k] for k in keys], float)
    return _posterior(prior, rate, cast, yes)


def cutoff(posteriors: np.ndarray, counts: np.ndarray) -> float:
    """The cutoff with the best expected F1, halfway between the last posterior it lets in and the next; 0.5 where there is nothing to choose by."""
    real = (counts * posteriors).sum()
    levels = np.unique(posteriors)[::-1]
    best, at = -1.0, 0.5
    for i, level in enumerate(levels):
        on = posteriors >= level
        if (f := 2 * (counts * posteriors)[on].sum() / (counts[on].sum() + real)) > best + 1e-9:
            best, at = f, float(level + (levels[i + 1] if i + 1 < len(levels) else 0.0)) / 2
    return at if levels.size and levels[0] >= 0.5 else 0.5


def ballots(generations: DataFrame, rulings: DataFrame) -> DataFrame:
    """``gen_id``, one vote pattern a defect: the labelling functions over every generation and its ruling's question."""
    asked = rulings.where("ruling_id IS NOT NULL").groupBy("ruling_id").agg(F.max("question").alias("question"))
    answers = generations.select("gen_id", "ruling_id", "text", "done_reason").where("gen_id IS NOT NULL")
    rows = salted_join(answers, asked, ["ruling_id"], F.col("gen_id"), "left").select("gen_id", "text", "done_reason", "question")
    shared = generations.sparkSession.sparkContext.broadcast(profiles(asked))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = {1: "1", 0: "0", None: "-"}
        for batch in batches:
            said = [votes(*(x if isinstance(x, str) else None for x in row), shared.value) for row in zip(batch["text"], batch["done_reason"], batch["question"])]
            yield pd.DataFrame({"gen_id": batch["gen_id"], **{d: ["".join(code[v] for v in s[d]) for s in said] for d in DEFECTS}})

    return rows.mapInPandas(run, "gen_id bigint, " + ", ".join(f"{d} string" for d in DEFECTS))


def defects(generations: DataFrame, rulings: DataFrame) -> DataFrame:
    """``gen_id``, ``labels`` (every defect above its cutoff, in order), ``posteriors`` (map of all).

    ``generations`` has gen_id, ruling_id, text and done_reason, ``rulings`` ruling_id and question. A null text is empty; without
    a question (null, blank or unknown ruling) nothing is said about copy and language. Rows with a null gen_id are left
    out; repeated rows count once; a gen_id with several texts has the labels of all. Texts of any length are read whole. Empty tables give no rows.
    """
    cast = materialize(ballots(generations, rulings))
    half = F.pmod(F.xxhash64("gen_id"), F.lit(2)).alias("half")
    found = cast
    for defect in DEFECTS:
        # At most 3 ** functions patterns, however many rows.
        counted = cast.groupBy(defect, half).count().collect()
        sides = [{r[0]: r["count"] for r in counted if r["half"] == h} for h in (0, 1)]
        every = Counter(sides[0]) + Counter(sides[1])
        keys = sorted(every) or ["-"]
        if sides[0] and sides[1]:
            other = list(sides[1])
            limit = cutoff(posterior(*fit(sides[0]), other), np.array([sides[1][k] for k in other], float))
        else:
            limit = 0.5
        scores = posterior(*fit(dict(every) or {"-": 1}), keys)
        table = [(k, float(s), bool(s >= limit)) for k, s in zip(keys, scores)]
        table_df = cast.sparkSession.createDataFrame(table, f"{defect} string, p_{defect} double, is_{defect} boolean")
        found = found.join(F.broadcast(table_df), defect, "left")
    labels = F.filter(F.array(*[F.when(F.col(f"is_{d}"), F.lit(d)) for d in DEFECTS]), lambda x: x.isNotNull())
    rows = found.select("gen_id", labels.alias("labels"), *[f"p_{d}" for d in DEFECTS])
    merged = rows.groupBy("gen_id").agg(F.array_distinct(F.flatten(F.collect_set("labels"))).alias("l"), *[F.max(f"p_{d}").alias(d) for d in DEFECTS])
    order = F.array(*[F.lit(d) for d in DEFECTS])
    return merged.select(
        "gen_id", F.filter(order, lambda d: F.array_contains("l", d)).alias("labels"),
        F.create_map(*[x for d in DEFECTS for x in (F.lit(d), F.round(d, 6))]).alias("posteriors"),
    )
