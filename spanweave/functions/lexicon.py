"""Base forms of words through endings, variations and meaning groups.

The lexicon is a parameter; the default is for Telugu. A base form is a pure function of one
word, so a data set's distinct words are mapped once and joined back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from .similarity import best_possible, indel_ratio

# Endings in the order in which they are tried.
TELUGU_ENDINGS = [
    "లో", "లోని", "కి", "తో", "ను", "లు", "ని", "కు", "డు",
    "రాలు", "డిని", "నికి", "లను", "లతో", "గారు", "వు",
    "లోపల", "బయట", "వైపు", "వెంట", "మీద", "క్రింద",
]

# Variations of country names.
TELUGU_VARIATIONS = {
    "చైన": ["చైనా", "చైనీస్"],
    "అమెరిక": ["అమెరికా", "అమెరికన్"],
    "రష్య": ["రష్యా", "రష్యన్"],
    "జపాన్": ["జపాన్", "జపనీస్"],
    "భారత": ["భారత్", "భారతీయ"],
    "బ్రిటన్": ["బ్రిటన్", "బ్రిటిష్"],
}

# Words of like meaning.
TELUGU_MEANINGS = {
    "సుమారు": ["సుమారు", "దాదాపు", "దరిదాపు", "ఇంచుమించు", "అంచనా", "గణన"],
    "చాలా": ["చాలా", "అనేక", "పెక్కు", "ఎక్కువ", "అధిక", "మరింత", "మరిన్ని", "విస్తారంగా"],
    "అన్ని": ["అన్ని", "అందరూ", "ప్రతి", "సమస్త", "సకల", "మొత్తం"],
    "ఇప్పుడు": ["ఇప్పుడు", "ప్రస్తుతం", "నేడు", "వర్తమానం"],
    "అప్పుడు": ["అప్పుడు", "ఆనాడు", "ఆరోజు", "ఆసమయం"],
    "కొన్ని": ["కొన్ని", "కొందరు", "కొంత", "కొద్ది"],
    "ప్రకారం": ["ప్రకారం", "అనుసారం", "ననుసరించి", "బట్టి"],
    "కానీ": ["కానీ", "అయితే", "గానీ", "కాని"],
    "కాబట్టి": ["కాబట్టి", "అందుచేత", "దీనివల్ల", "అందువల్ల", "కనుక"],
    "మళ్ళీ": ["మళ్ళీ", "మరల", "తిరిగి", "మరలా", "మరొక్కసారి"],
    "మాత్రమే": ["మాత్రమే", "కేవలం", "పరిమితం"],
    "కలిసి": ["కలిసి", "కూడా", "సహా", "తోపాటు", "వెంట"],
    "ముందు": ["ముందు", "పూర్వం", "ఇంతకుముందు", "ఇదివరకు", "గతంలో"],
    "తర్వాత": ["తర్వాత", "పిమ్మట", "అనంతరం", "ఆ పైన"],
    "మధ్య": ["మధ్య", "నడుమ", "మధ్యన", "మధ్యలో"],
    "పూర్తిగా": ["పూర్తిగా", "సంపూర్ణంగా", "మొత్తంగా", "సమగ్రంగా"],
    "వెంటనే": ["వెంటనే", "తక్షణమే", "అప్పటికప్పుడు"],
    "సాధారణంగా": ["సాధారణంగా", "మామూలుగా", "ఎక్కువగా", "పలుమారు"],
    "రాక్షస": ["రాక్షసుడు", "దెయ్యం", "భూతం", "పిశాచి", "దానవుడు", "అసురుడు", "రాక్షసి"],
    "దేవ": ["దేవుడు", "దైవం", "భగవంతుడు", "ప్రభువు", "స్వామి"],
}


@dataclass
class Lexicon:
    endings: list[str] = field(default_factory=lambda: list(TELUGU_ENDINGS))
    variations: dict[str, list[str]] = field(default_factory=lambda: dict(TELUGU_VARIATIONS))
    meanings: dict[str, list[str]] = field(default_factory=lambda: dict(TELUGU_MEANINGS))
    alike: float = 0.8

    def __post_init__(self) -> None:
        self._bases: dict[str, str] = {}
        self._pairs: dict[tuple[str, str], bool] = {}

    def base(self, word: str) -> str:
        """The base form of one word (memoized)."""
        known = self._bases.get(word)
        if known is None:
            if len(self._bases) > 500_000:
                self._bases.clear()
            known = self._bases[word] = self._find(word)
        return known

    def _find(self, word: str) -> str:
        # Variations and meanings look at the word as it stands; they outrank its ending.
        for base, forms in self.variations.items():
            if word in forms or word.startswith(base):
                return base
        exact = next((k for k, forms in self.meanings.items() if word in forms), None)
        if exact is not None:
            return exact
        partly = [k for k, forms in self.meanings.items() if any(self._touches(word, f) for f in forms)]
        if partly:
            return partly[-1]  # of several partly matching groups the last counts
        ending = next((e for e in self.endings if word.endswith(e)), "")
        return word[: len(word) - len(ending)] if ending else word

    def _touches(self, word: str, form: str) -> bool:
        return form.startswith(word) or word.startswith(form) or indel_ratio(word.lower(), form.lower()) > self.alike

    def equivalent(self, a: str, b: str) -> bool:
        """Equal base forms, or spellings more alike than ``alike`` (memoized)."""
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) > 500_000:
                self._pairs.clear()
            longest = best_possible(len(a), len(b)) > self.alike
            known = self._pairs[a, b] = self.base(a) == self.base(b) or longest and indel_ratio(a.lower(), b.lower()) > self.alike
        return known
