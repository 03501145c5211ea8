"""Decide whether a Python-dialect regex may run on the JVM, line by line.

A pattern is *line-safe* when every match over a whole text lies inside one ``\\n``
line and matching each line alone finds the same matches: it cannot match ``\\n``,
cannot match the empty string, and has no anchor or look-around whose answer depends
on text outside the line (``\\b``/``\\B`` are fine: ``\\n`` is a non-word character,
just like the edge of a line).

Such a pattern is re-written into Java syntax with Python's meaning spelled out
(Unicode ``\\w``/``\\d``, ``.`` = anything but ``\\n``).  Anything not understood
returns ``None`` and the caller uses the exact Python route.  Python's own parser is
used; nothing here parses regex text by hand.
"""

from __future__ import annotations

try:  # Python 3.11+
    import re._constants as C
    import re._parser as P
except ImportError:  # pragma: no cover
    import sre_constants as C  # type: ignore
    import sre_parse as P  # type: ignore

from trawl.model import Query

NL = 10

# Python's str-pattern classes, in Java syntax.
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
SPACE = r"\t\n\x0B\x0C\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


# The non-ASCII characters that IGNORECASE matches to an ASCII letter and
# that lower() does not turn into that letter (checked over all code points).
FOLD_TO_ASCII_FROM = "\u0130\u0131\u017F"
FOLD_TO_ASCII_TO = "iis"


# Under IGNORECASE an ASCII pattern item can only match ASCII characters and these four.
FOLD_CANDIDATES = [chr(c) for c in range(128)] + list(FOLD_TO_ASCII_FROM) + ["\u212A"]


class _Unsafe(Exception):
    pass


def _char(code: int) -> str:
    ch = chr(code)
    if ch.isascii() and ch.isalnum():
        return ch
    return "\\x{%X}" % code


def _fold_set(py_class: str) -> str:
    """Java class body for the characters Python matches with ``py_class`` under
    IGNORECASE (decided by Python's own engine over the only possible candidates)."""
    import re

    rx = re.compile(py_class, re.IGNORECASE)
    return "".join(_char(ord(c)) for c in FOLD_CANDIDATES if rx.fullmatch(c))


def _py_item(op, av) -> str:
    import re

    if op is C.LITERAL:
        return re.escape(chr(av))
    lo, hi = av
    return f"{re.escape(chr(lo))}-{re.escape(chr(hi))}"


def _class_item(op, av, ascii_only: bool) -> tuple[str, bool]:
    """(java text, may match newline) of one item inside ``[...]``."""
    if op is C.LITERAL:
        if ascii_only and av > 127:
            raise _Unsafe
        text = _fold_set("[" + _py_item(op, av) + "]") if ascii_only else _char(av)
        return text, av == NL
    if op is C.RANGE:
        lo, hi = av
        if ascii_only and hi > 127:
            raise _Unsafe
        text = _fold_set("[" + _py_item(op, av) + "]") if ascii_only else f"{_char(lo)}-{_char(hi)}"
        return text, lo <= NL <= hi
    if op is C.CATEGORY:
        if av is C.CATEGORY_DIGIT:
            return DIGIT, False
        if av is C.CATEGORY_WORD:
            return WORD, False
        if av is C.CATEGORY_NOT_SPACE:
            return f"[^{SPACE}]", False
        raise _Unsafe  # \s, \D, \W all contain \n
    raise _Unsafe


def _in(items, ascii_only: bool) -> str:
    negate = False
    parts, has_nl = [], False
    for op, av in items:
        if op is C.NEGATE:
            negate = True
            continue
        text, nl = _class_item(op, av, ascii_only)
        parts.append(text)
        has_nl = has_nl or nl
    if negate:
        if not has_nl:
            # [^...] matches \n unless \n is excluded; exclude it explicitly
            raise _Unsafe
        return "[^" + "".join(parts) + "]"
    if has_nl:
        raise _Unsafe
    return "[" + "".join(parts) + "]"


def _boundary(negated: bool) -> str:
    w = f"[{WORD}]"
    if negated:
        return f"(?:(?<={w})(?={w})|(?<!{w})(?!{w}))"
    return f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))"


def _is_word_token(tok) -> bool:
    """A token that always consumes one word character (so ``\\b`` next to it is one-sided)."""
    op, av = tok
    if op is C.LITERAL:
        ch = chr(av)
        return ch.isalnum() or ch == "_"
    if op is C.IN:
        items = [x for x in av if x[0] is not C.NEGATE]
        if len(items) != len(av) or not items:
            return False
        for iop, iav in items:
            if iop is C.CATEGORY and iav is C.CATEGORY_WORD:
                continue
            if iop is C.LITERAL and (chr(iav).isalnum() or chr(iav) == "_"):
                continue
            if iop is C.RANGE and all(chr(c).isalnum() for c in (iav[0], iav[1])) and (
                iav[1] - iav[0] < 26 and (chr(iav[0]).isdigit() == chr(iav[1]).isdigit())
            ):
                continue
            return False
        return True
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and av[0] >= 1:
        sub = list(av[2])
        return bool(sub) and _is_word_token(sub[0]) and len(sub) == 1
    return False


#: Repetitions of a group that Java may recurse into.
MAX_GROUP_REPEAT = 32


def _has_repeat(tokens) -> bool:
    """Is there a repeat anywhere inside?"""
    for op, av in tokens:
        if op in (C.MAX_REPEAT, C.MIN_REPEAT) or op is getattr(C, "POSSESSIVE_REPEAT", None):
            return True
        inner = [av[3]] if op is C.SUBPATTERN else list(av[1]) if op is C.BRANCH else [av] if op is getattr(C, "ATOMIC_GROUP", None) else []
        if any(_has_repeat(i) for i in inner):
            return True
    return False


def _seq(tokens, ascii_only: bool) -> str:
    out = []
    tokens = list(tokens)
    for pos, (op, av) in enumerate(tokens):
        nxt = tokens[pos + 1] if pos + 1 < len(tokens) else None
        prv = tokens[pos - 1] if pos > 0 else None
        if op is C.AT and av is C.AT_BOUNDARY and (nxt is not None and _is_word_token(nxt)):
            out.append(f"(?<![{WORD}])")  # a word character follows: only the left side matters
            continue
        if op is C.AT and av is C.AT_BOUNDARY and (prv is not None and _is_word_token(prv)):
            out.append(f"(?![{WORD}])")
            continue
        if op is C.LITERAL:
            if av == NL or (ascii_only and av > 127):
                raise _Unsafe
            if ascii_only:
                body = _fold_set("[" + _py_item(op, av) + "]")
                out.append(body if len(body) == 1 else f"[{body}]")
            else:
                out.append(_char(av))
        elif op is C.NOT_LITERAL:
            if av != NL:
                raise _Unsafe
            out.append("[^\\n]")
        elif op is C.ANY:
            out.append("[^\\n]")
        elif op is C.IN:
            out.append(_in(av, ascii_only))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) or op is getattr(C, "POSSESSIVE_REPEAT", None):
            lo, hi, sub = av
            sub = list(sub)
            if len(sub) == 1 and sub[0][0] in (C.LITERAL, C.NOT_LITERAL, C.ANY, C.IN):
                body = _seq(sub, ascii_only)  # one character class: a loop without recursion in Java
            elif hi is not C.MAXREPEAT and hi <= MAX_GROUP_REPEAT and not _has_repeat(sub):
                body = "(?:" + _seq(sub, ascii_only) + ")"
            else:
                raise _Unsafe  # Java recurses per repetition of a group
            hi_text = "" if hi is C.MAXREPEAT else str(hi)
            quant = "{%d,%s}" % (lo, hi_text) if hi_text != str(lo) else "{%d}" % lo
            suffix = "?" if op is C.MIN_REPEAT else ("+" if op is not C.MAX_REPEAT else "")
            out.append(body + quant + suffix)
        elif op is C.SUBPATTERN:
            _group, add_flags, del_flags, sub = av
            if add_flags or del_flags:
                raise _Unsafe
            out.append("(?:" + _seq(sub, ascii_only) + ")")
        elif op is getattr(C, "ATOMIC_GROUP", None):
            out.append("(?>" + _seq(av, ascii_only) + ")")
        elif op is C.BRANCH:
            _none, alts = av
            out.append("(?:" + "|".join(_seq(a, ascii_only) for a in alts) + ")")
        elif op is C.AT:
            if av is C.AT_BOUNDARY:
                out.append(_boundary(False))
            elif av is C.AT_NON_BOUNDARY:
                out.append(_boundary(True))
            else:
                raise _Unsafe  # ^ $ \A \Z look outside the line
        else:
            raise _Unsafe  # look-around, back-references, conditionals
    return "".join(out)


def required_literal(query: Query) -> str | None:
    """The longest run of literal characters that every match must contain (top-level
    only), lower-cased for case-insensitive queries; ``None`` if there is none usable."""
    if not query.regex:
        return None
    try:
        parsed = P.parse(query.text, 0 if query.case_sensitive else 2)
    except Exception:
        return None
    ignore_case = bool(parsed.state.flags & 2)  # asked for, or by an inline (?i)
    best, run = "", ""
    for op, av in parsed:
        if op is C.LITERAL:
            run += chr(av)
            best = max(best, run, key=len)
        else:
            run = ""
    if not best:
        return None
    if ignore_case:
        if not best.isascii():
            return None
        best = best.lower()
    return best


def ignores_case(query: Query) -> bool:
    """By its option or by an inline ``(?i)``."""
    if not query.case_sensitive:
        return True
    return bool(query.regex and P.parse(query.text, 0).state.flags & 2)


def _mentions(tokens) -> set:
    """The categories and boundaries a pattern uses, at any depth."""
    found = set()
    for op, av in tokens:
        if op is C.AT:
            found.add(av)
        elif op is C.IN:
            found |= {v for o, v in av if o is C.CATEGORY}
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) or op is getattr(C, "POSSESSIVE_REPEAT", None):
            found |= _mentions(av[2])
        elif op is C.SUBPATTERN:
            found |= _mentions(av[3])
        elif op is C.BRANCH:
            for branch in av[1]:
                found |= _mentions(branch)
        elif op is getattr(C, "ATOMIC_GROUP", None):
            found |= _mentions(av)
    return found


_DIFFERING: dict = {}


def _differing(spark, java_class: str, python_class: str) -> list[tuple[int, int]]:
    """Code point ranges on which the JVM's class and Python's disagree (asked of both
    engines once per process: their Unicode tables differ by version)."""
    import re

    if java_class not in _DIFFERING:
        everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        pattern = spark._jvm.java.util.regex.Pattern.compile(f"[^{java_class}]")
        java = set(pattern.matcher(everything).replaceAll(""))
        points = sorted(map(ord, java ^ set(re.findall(python_class, everything))))
        ranges: list[list[int]] = []
        for p in points:
            if ranges and ranges[-1][1] == p - 1:
                ranges[-1][1] = p
            else:
                ranges.append([p, p])
        _DIFFERING[java_class] = [tuple(r) for r in ranges]
    return _DIFFERING[java_class]


def jvm_may_differ(query: Query, text):
    """A test for the texts on which the Java pattern of a regex query may not mean what
    Python means: characters that only one engine counts as word characters or digits, and, next
    to a boundary, characters outside the BMP (Java looks behind by half of them).
    ``None`` when the pattern uses neither."""
    from pyspark.sql import SparkSession

    used = _mentions(P.parse(query.text, 0 if query.case_sensitive else 2))
    boundary = bool(used & {C.AT_BOUNDARY, C.AT_NON_BOUNDARY})
    spark = SparkSession.getActiveSession()
    ranges: list[tuple[int, int]] = []
    if boundary or C.CATEGORY_WORD in used:
        ranges += _differing(spark, WORD, r"\w")
    if C.CATEGORY_DIGIT in used:
        ranges += _differing(spark, DIGIT, r"\d")
    if boundary:
        ranges.append((0x10000, 0x10FFFF))
    if not ranges:
        return None
    low = min(lo for lo, _ in ranges)
    listed = "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in ranges)
    # most texts hold nothing beyond the lowest of these characters: one range to test
    return text.rlike(f"[\\x{{{low:X}}}-\\x{{10FFFF}}]") & text.rlike(f"[{listed}]")


def literal_test(text, query: Query, must: str):
    """A cheap test that is true for every text holding a match (``must`` comes from
    :func:`required_literal`).  Case-insensitive: ``lower(text)`` contains it, or the
    text holds one of the few characters that fold onto a letter of it."""
    from pyspark.sql import functions as F

    if not ignores_case(query):
        return text.contains(must)
    test = F.lower(text).contains(must)
    for src, dst in zip(FOLD_TO_ASCII_FROM, FOLD_TO_ASCII_TO):
        if dst in must:
            test = test | text.contains(src)
    return test


def java_line_pattern(query: Query) -> str | None:
    """The Java pattern equal to ``query`` on single lines, or ``None`` if unsafe."""
    if not query.regex or not query.text:
        return None
    flags = 0 if query.case_sensitive else 2  # re.IGNORECASE
    try:
        parsed = P.parse(query.text, flags)
    except Exception:
        return None
    if parsed.state.flags & ~(2 | 32):  # only IGNORECASE (and the implicit UNICODE) allowed
        return None
    lo, _hi = parsed.getwidth()
    if lo == 0:
        return None
    try:
        body = _seq(list(parsed), ascii_only=bool(parsed.state.flags & 2))
    except _Unsafe:
        return None
    # case-insensitive items were expanded into their exact IGNORECASE sets, so the
    # Java pattern runs case-sensitively (faster, and no engine differences left)
    return body
