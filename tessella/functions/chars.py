"""Character classes of Java regular expressions that match Python's str methods.

Java's ``\\s``, ``\\d`` and ``trim`` are ASCII only, but pages are full of no-break spaces and signs
such as the ² of m². Below U+0500 each class agrees with Python exactly.
"""

#: str.isspace()
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: str.isdigit(): decimal digits, and superscript, subscript, circled and the like
DIGIT = (
    r"\p{Nd}\x{b2}\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}"
    r"\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}\x{24f5}-\x{24fd}\x{24ff}\x{2776}-\x{277e}\x{2780}-\x{2788}"
    r"\x{278a}-\x{2792}\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}"
)
LETTER, ALNUM = r"\p{L}", r"\p{L}\p{N}"
UPPER, LOWER = r"\p{IsUppercase}", r"\p{IsLowercase}"
#: Vowels of Italian.
VOWELS = "aeiouàèéìòù"
#: Capitals of a run.
CAPITALS = "A-ZÀ-ÖØ-Ý"
