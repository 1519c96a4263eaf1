"""Character classes and case folding shared by the expression engines."""

# Python's str.isspace() characters, written for a Java character class.
SPACE_CLASS = r"\t-\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD_CLASS = r"\p{L}\p{N}_"
# Characters that Unicode case folding maps to an ASCII letter besides that letter's own case.
FOLD_FROM, FOLD_TO = "\u017f\u0131\u0130\u212a", "siik"
