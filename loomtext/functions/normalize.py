"""Word tests, stop lists, stemmers, lemmas and final terms."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# English function words, those that the domain keeps, and corpus noise.
ENGLISH = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their "
    "theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through during before after above below to from up down in out on "
    "off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so "
    "than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn "
    "hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won "
    "won't wouldn wouldn't he'd he'll he's i'd i'll i'm i've it'd it'll it's she'd she'll she's that'll they'd they'll they're they've we'd we'll we're we've you'd you'll you're you've"
).split()
KEEP = "not no nor more most than over under same each few all both before after above below up down off out only very again further don't doesn't didn't isn't wasn't aren't can't couldn't won't shouldn't".split()
NOISE = "et al fig pp arxiv doi eq authors venue um uh umm hmm mmm okay ok yeah".split()


def stopwords(name: str | None) -> frozenset[str]:
    """none, nltk (the English list), custom (without KEEP, with NOISE), spark (the list of Spark's own remover)."""
    if name in (None, "none"):
        return frozenset()
    if name in ("nltk", "english"):
        return frozenset(ENGLISH)
    if name == "custom":
        return frozenset(ENGLISH) - frozenset(KEEP) | frozenset(NOISE)
    if name in ("spark", "spacy"):
        from pyspark.ml.feature import StopWordsRemover

        return frozenset(StopWordsRemover.loadDefaultStopWords("english"))
    raise ValueError(name)


def write_stopwords(path: str, name: str = "custom") -> list[str]:
    words = sorted(stopwords(name))
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(words) + "\n")
    return words


def is_word(t: Column) -> Column:
    return t.rlike(r"[\p{L}\p{N}]")


def normalize_term(t: Column) -> Column:
    low = F.lower(t)
    return F.when(low.endswith("'s") & (F.length(low) > 3), F.substring(low, F.lit(1), F.length(low) - 2)).otherwise(low)


def in_list(t: Column, words: frozenset[str]) -> Column:
    """Membership in a small fixed list, as a set lookup."""
    return t.isin(sorted(words)) if words else F.lit(False)


# ---- stemmers
def stem_regexp(t: Column) -> Column:
    """Common inflections of words of five letters and more; words with digits or without letters stay."""
    plain = t.rlike("[A-Za-z]") & ~t.rlike("[0-9]") & (F.length(t) >= 5)
    return F.when(plain, F.regexp_replace(t, "(ing|ed|es|s)$", "")).otherwise(t)


_V = "aeiou"


def _cons(w: str, i: int) -> bool:
    return w[i] not in _V and (w[i] != "y" or i == 0 or not _cons(w, i - 1))


def _measure(w: str) -> int:
    kinds = [_cons(w, i) for i in range(len(w))]
    return sum(1 for a, b in zip(kinds, kinds[1:]) if not a and b)


def _has_vowel(w: str) -> bool:
    return any(not _cons(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    return len(w) > 2 and _cons(w, len(w) - 3) and not _cons(w, len(w) - 2) and _cons(w, len(w) - 1) and w[-1] not in "wxy"


# Suffix tables of the 1980 paper.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


@lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """Porter's 1980 algorithm on lower-case words; words of two letters, with digits or without letters stay."""
    if not re.search("[A-Za-z]", word) or re.search(r"\d", word):
        return word
    w = word.lower()
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                if _has_vowel(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif _double(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _cvc(w):
                        w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, new in sorted(table, key=lambda x: -len(x[0])):
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in sorted(_STEP4, key=lambda x: -len(x)):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


# Suffix tables and exceptions of the English Snowball stemmer ("Porter2").
_S2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
_S3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_S4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()
_S_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_S_SAME = "sky news howe atlas cosmos bias andes".split()
_S_STOP = "inning outing canning herring earring proceed exceed succeed".split()


@lru_cache(maxsize=200_000)
def snowball(word: str) -> str:
    """The English Snowball algorithm; numbers, words with digits or without letters stay."""
    if not re.search("[A-Za-z]", word) or re.search(r"\d", word):
        return word
    w = word.lower().replace("\u2019", "'").lstrip("'")
    if len(w) <= 2:
        return w
    if w in _S_WHOLE or w in _S_SAME:
        return _S_WHOLE.get(w, w)
    w = re.sub("(^|[aeiouy])y", lambda m: m[1] + "Y", w)
    vowel = "[aeiouy]"

    def region(text: str) -> str:
        m = re.search(f"{vowel}[^aeiouy](.*)$", text)
        return m[1] if m else ""

    m = re.match("(gener|commun|arsen)(.*)$", w)
    r1 = len(m[2]) if m else len(region(w))
    r1_at = len(w) - r1
    r2_at = len(w) - len(region(w[r1_at:]))

    def short(text: str) -> bool:
        return bool(re.search("[^aeiouy][aeiouy][^aeiouywxY]$", text) or re.fullmatch("[aeiouy][^aeiouy]", text))

    w = re.sub("('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(vowel, w[:-2]):
        w = w[:-1]
    if w in _S_STOP:
        return w
    if m := re.search("(eedly|eed)$", w):
        w = w[: m.start()] + "ee" if m.start() >= r1_at else w
    elif (m := re.search("(ingly|edly|ing|ed)$", w)) and re.search(vowel, w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif short(w) and len(w) <= r1_at:
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"

    def longest(table):
        return next((e for e in sorted(table, key=len, reverse=True) if w.endswith(e)), None)

    e = longest([*_S2, "ogi", "li"])
    if e and len(w) - len(e) >= r1_at:
        stem = w[: -len(e)]
        w = stem + _S2[e] if e in _S2 else stem + "og" if e == "ogi" and stem.endswith("l") else stem if e == "li" and stem[-1:] in tuple("cdeghkmnrt") else w
    e = longest([*_S3, "ative"])
    if e and len(w) - len(e) >= r1_at:
        w = w[: -len(e)] + _S3[e] if e in _S3 else w[: -len(e)] if len(w) - len(e) >= r2_at else w
    e = longest([*_S4, "ion"])
    if e and len(w) - len(e) >= r2_at and (e != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(e)]
    if w.endswith("e") and (len(w) - 1 >= r2_at or (len(w) - 1 >= r1_at and not short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2_at:
        w = w[:-1]
    return w.lower()


# The rules of the Paice-Husk ("Lancaster") stemmer: ending reversed, * for whole words only, letters lost, what is put on, and > to go on or . to stop.
_HUSK = (
    "ai*2. a*1. bb1. city3s. ci2> cn1t> dd1. dei3y> deec2ss. dee1. de2> dooh4> e1> feil1v. fi2> gni3> gai3y. ga2> gg1. ht*2. hsiug5ct. hsi3> i*1. i1y> ji1d. juf1s. ju1d. jo1d. jeh1r. jrev1t. jsim2t. jn1d. j1s. "
    "lbaifi6. lbai4y. lba3> lbi3. lib2l> lc1. lufi4y. luf3> lu2. lai3> lau3> la2> ll1. mui3. mu*2. msi3> mm1. nois4j> noix4ct. noi3> nai3> na2> nee0. ne2> nn1. pihs4> pp1. re2> rae0. ra2. ro2> ru2> rr1. rt1> rei3y> sei3y> "
    "sis2. si2> ssen4> ss0. suo3> su*2. s*1> s0. tacilp4y. ta2> tnem4> tne3> tna3> tpir2b. tpro2b. tcud1. tpmus2. tpec2iv. tulo2v. tsis0. tsi3> tt1. uqi3. ugo1. vis3j> vie0. vi2> ylb1> yli3y> ylp0. yl2> ygo1. yhp1. ymo1. "
    "ypo1. yti3> yte3> ytl2. yrtsi5. yra3> yro3> yfi3. ycn2t> yca3> zi2> zy1s."
).split()
_HUSK_RULES = [(m[1][::-1], bool(m[2]), int(m[3]), m[4], m[5] == ">") for m in (re.fullmatch(r"([a-z]+)(\*?)(\d)([a-z]*)([>.])", r) for r in _HUSK)]


@lru_cache(maxsize=200_000)
def lancaster(word: str) -> str:
    """The Paice-Husk algorithm; numbers, words with digits or without letters stay."""
    if not re.search("[A-Za-z]", word) or re.search(r"\d", word):
        return word
    w = whole = word.lower()
    going = True
    while going and w[-1:].isalpha():
        going = False
        for end, intact, lost, new, on in _HUSK_RULES:
            if w.endswith(end) and (not intact or w == whole):
                left = len(w) - lost
                if left >= 2 if w[0] in "aeiouy" else left >= 3 and (w[1] in "aeiouy" or w[2] in "aeiouy"):
                    w, going = w[:left] + new, on
                    break
    return w


@F.pandas_udf(StringType())
def stem_porter(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else porter(w))


@F.pandas_udf(StringType())
def stem_snowball(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else snowball(w))


@F.pandas_udf(StringType())
def stem_lancaster(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else lancaster(w))


# ---- lemmas: exceptions first, then suffix rules by part of speech. A substitute for a dictionary that is not available here.
# Irregular forms.
_IRREGULAR = {
    "v": {"was": "be", "were": "be", "is": "be", "are": "be", "am": "be", "been": "be", "had": "have", "has": "have", "did": "do", "does": "do", "done": "do", "went": "go", "gone": "go", "said": "say", "made": "make", "took": "take", "taken": "take", "gave": "give", "given": "give", "got": "get", "found": "find", "thought": "think", "wrote": "write", "written": "write", "knew": "know", "known": "know", "saw": "see", "seen": "see", "came": "come", "kept": "keep", "left": "leave", "taught": "teach", "meant": "mean", "told": "tell", "felt": "feel", "ate": "eat"},
    "n": {"men": "man", "women": "woman", "children": "child", "people": "people", "feet": "foot", "teeth": "tooth", "mice": "mouse", "halves": "half", "indices": "index", "vertices": "vertex", "matrices": "matrix", "analyses": "analysis", "hypotheses": "hypothesis"},
    "a": {"better": "good", "best": "good", "worse": "bad", "worst": "bad", "further": "far", "more": "more", "most": "most"},
}
_SUFFIX = {"n": [("ies", "y"), ("sses", "ss"), ("xes", "x"), ("ches", "ch"), ("shes", "sh"), ("zes", "z"), ("s", "")], "v": [("ies", "y"), ("ied", "y"), ("sses", "ss"), ("ches", "ch"), ("shes", "sh"), ("xes", "x"), ("ing", ""), ("ed", ""), ("s", "")], "a": [("ier", "y"), ("iest", "y"), ("er", ""), ("est", "")], "r": []}


@lru_cache(maxsize=200_000)
def lemma(word: str, pos: str = "n") -> str:
    w = word.lower()
    if re.search(r"\d", word):
        return word
    if w in _IRREGULAR.get(pos, {}):
        return _IRREGULAR[pos][w]
    for end, new in _SUFFIX.get(pos, []):
        if w.endswith(end) and len(w) - len(end) >= 3 and not w.endswith(("ss", "us", "is")):
            stem = w[: -len(end)] + new
            if end in ("ing", "ed"):
                if not _has_vowel(stem):
                    return w
                if _double(stem) and stem[-1] not in "lsz":
                    stem = stem[:-1] if len(stem) > 3 else stem  # running, but adding
                elif stem.endswith(("at", "bl", "iz", "v", "c", "u", "g")) or (_measure(stem) == 1 and _cvc(stem)):
                    stem += "e"
            return stem
    return w


def lemma_context_free(word: str) -> str:
    """Verb, then noun, then adjective: the first that changes the word."""
    w = word.lower()
    if not w.isalpha():
        return w
    return next((x for x in (lemma(w, p) for p in "vna") if x != w), w)


def penn_to_wordnet(tag: Column) -> Column:
    first = F.substring(tag, 1, 1)
    return F.when(first == "J", "a").when(first == "V", "v").when(first == "R", "r").otherwise("n")


@F.pandas_udf(StringType())
def lemma_cf(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else lemma_context_free(w))


@F.pandas_udf(StringType())
def lemma_noun(words: pd.Series) -> pd.Series:
    return words.map(lambda w: None if w is None else lemma(w, "n"))


#: Lower-case word to normalised word.
NORMALIZERS = {
    "none": lambda t: t, "regexp": stem_regexp, "porter": stem_porter, "snowball": stem_snowball, "lancaster": stem_lancaster,
    "wordnet_nopos": lemma_noun, "wordnet_cf": lemma_cf, "wordnet_pos": lemma_cf, "spacy": lemma_cf,
}
_NATIVE = {"none", "regexp"}


def add_norm(tokens: DataFrame, normalizer: str, surface: str = "surface") -> DataFrame:
    """Adds ``norm``. A Python normaliser sees each distinct lower-case word once, joined back to the tokens."""
    if normalizer not in NORMALIZERS:
        raise ValueError(f"no normalizer {normalizer!r}")
    f = NORMALIZERS[normalizer]
    if normalizer in _NATIVE:
        return tokens.withColumn("norm", normalize_term(f(F.lower(surface))))
    low = tokens.withColumn("_low", F.lower(surface))
    words = low.select("_low").distinct()
    return low.join(words.withColumn("norm", normalize_term(f(F.col("_low")))), "_low").drop("_low")
