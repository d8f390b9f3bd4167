"""Text profiles: the patterns that make the corpus operators fit a language and a genre."""

from __future__ import annotations

from dataclasses import dataclass

#: White space as Python's str.split() sees it; spelled out, as no regex engine's \s agrees with it.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The characters of SPACE one by one, for functions that take no pattern.
SPACES = "".join(map(chr, (*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
#: Where only lines that aren't empty count, any one of these characters ends a line.
BREAK = r"[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"


@dataclass(frozen=True)
class Profile:
    name: str
    token: str  # a run that counts as a token
    token_fold: bool  # tokens are taken from the lower-cased text
    sentence_end: str  # a character class body: sentences end behind one of these
    title: str  # a stripped line that opens an episode or chapter
    scene: str
    speech: str  # group 1 the speaker, group 2 what is said
    not_speaker: str
    hooks: tuple[str, ...]  # substrings that mark a hook line
    letter: str  # the character class body of the quality gate
    gate_chars: int
    gate_ratio: float
    short_phrase: int  # phrases shorter than this need document frequency 2


#: Fixed values of the Chinese short-drama genre.
ZH_DRAMA = Profile(
    name="zh_drama",
    token=r"[一-龥]{2,6}",
    token_fold=False,
    sentence_end="。!…?",
    title=r"^第[0-9零一二三四五六七八九十百千]+[集章]",
    scene=r"^场景[:：]",
    speech=r"^([一-龥A-Za-z]{1,8})[:：](.+)",
    not_speaker="场景",
    hooks=("【钩子】", "【悬念】", "【反转】"),
    letter=r"\x{4e00}-\x{9fff}",
    gate_chars=200,
    gate_ratio=0.4,
    short_phrase=4,
)

#: The same operators over texts in Latin script: short one-word lines open units, lines in capitals scenes.
LATIN = Profile(
    name="latin",
    token=r"[a-zà-öø-ÿ]{4,12}",
    token_fold=True,
    sentence_end=".!?",
    title=r"^[A-ZÀ-Þ][a-zà-öø-ÿ]{1,4}\.$",
    scene=r"^[A-Z]{2,}",
    speech=r"^([A-Za-z]{1,8}): *(.+)",
    not_speaker="SCENE",
    hooks=("!!", "||", "%%%"),
    letter="A-Za-zÀ-ÖØ-öø-ÿ",
    gate_chars=200,
    gate_ratio=0.4,
    short_phrase=6,
)
