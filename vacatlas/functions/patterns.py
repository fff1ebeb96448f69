"""Patterns, with the Unicode character classes spelled out.

Java's ``\\s \\d \\w \\b`` are ASCII unless told otherwise.
"""

from __future__ import annotations

import re

#: White space other than the plain blank, Unicode. Plain ASCII is ruled out
#: first, which is what almost every character of a text is.
SPACE_NOT_BLANK = (
    r"[[^ -~]&&[\x09-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
)
#: White space.
SPACE = f"[ {SPACE_NOT_BLANK}]"
#: The same set as a string, for trimming.
SPACE_CHARS = "".join(
    chr(c)
    for c in [
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
        *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    ]
)
DIGIT = r"\p{Nd}"
#: Inside of a class of word characters.
WORD = r"\p{L}\p{N}_"

HTML_TAG = r"<[^>]+>"
BLANKS = " {2,}"
#: The ASCII part of it, one by one.
CONTROL_SPACES = [chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x20))]
SENTENCE_END = f"(?<=[.!?]){SPACE}+"

# Fixed patterns, tried in this order: a range of years, years of experience,
# a stated minimum, years that are relevant.
YEARS_RANGE = (
    rf"(?iu){DIGIT}+{SPACE}*[-–to]+{SPACE}*{DIGIT}+\+?{SPACE}*years?{SPACE}*(?:of{SPACE}+)?(?:experience|exp)"
)
YEARS_SINGLE = [
    rf"(?iu){DIGIT}+\+?{SPACE}*years?{SPACE}*(?:of{SPACE}+)?(?:experience|exp)",
    # Plain classes of what ``mi`` and ``at`` fold from pass over most characters before cases are folded.
    rf"(?=[mMaA][iItT\x{{130}}\x{{131}}])(?iu)(?:minimum|min|at{SPACE}+least){SPACE}+{DIGIT}+{SPACE}*years?",
    rf"(?iu){DIGIT}+{SPACE}*years?{SPACE}*(?:of{SPACE}+)?(?:experience|exp|relevant)",
]
#: Everything the patterns that start with a figure can match, so that these need
#: to look at such phrases only.
YEARS_PHRASE = (
    rf"(?iu){DIGIT}+(?:{SPACE}*[-–to]+{SPACE}*{DIGIT}+)?\+?{SPACE}*years?{SPACE}*(?:of{SPACE}+)?(?:experience|exp|relevant)"
)
SALARY_NUMBER = rf"({DIGIT}+\.?{DIGIT}*)"
STATE_CODE = rf",{SPACE}*([A-Z]{{2}})(?![{WORD}])"

# Fixed patterns: bulleted items, then numbered items, of 20 to 150 characters.
LISTED_ITEMS = [
    rf"[-•]{SPACE}*([^\n]{{20,150}}?)(?=[-•\n]|\z)",
    rf"{DIGIT}+\.{SPACE}*([^\n]{{20,150}}?)(?={DIGIT}+\.|\n|\z)",
]


def whole_word(word: str) -> str:
    """Pattern for ``word`` between word boundaries, led by the word itself.

    Leading with the literal lets the matcher skip along the text; the
    boundaries are looked at only where the literal occurs. A word that ends in
    a symbol needs a word character after it to have a boundary there.
    """
    body = re.escape(word)
    before = f"(?<![{WORD}]{body})" if _is_word(word[0]) else f"(?<=[{WORD}]{body})"
    after = f"(?![{WORD}])" if _is_word(word[-1]) else f"(?=[{WORD}])"
    return f"{body}{before}{after}"


def _is_word(char: str) -> bool:
    return char.isalnum() or char == "_"
