"""Linear-time regular expressions (RE2 syntax) for Spark's Java engine, checked before any job runs.

The pattern is read by the grammar of the linear-time engine. What that engine refuses is refused here; what both
read alike is passed on; what Java reads otherwise is rewritten.
"""

from __future__ import annotations

import re

import regex

_POSIX = {
    "alpha": r"\p{Alpha}", "digit": r"\p{Digit}", "alnum": r"\p{Alnum}", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "space": r"\p{Space}",
    "punct": r"\p{Punct}", "cntrl": r"\p{Cntrl}", "graph": r"\p{Graph}", "print": r"\p{Print}", "blank": r"\p{Blank}", "xdigit": r"\p{XDigit}", "word": r"\w", "ascii": r"\p{ASCII}",
}
#: Unicode general categories, and the greatest repeat count.
_CATEGORIES = {"C", "Cc", "Cf", "Co", "Cs", "L", "Ll", "Lm", "Lo", "Lt", "Lu", "M", "Mc", "Me", "Mn", "N", "Nd", "Nl", "No", "P", "Pc", "Pd", "Pe", "Pf", "Pi", "Po", "Ps", "S", "Sc", "Sk", "Sm", "So", "Z", "Zl", "Zp", "Zs"}
_MOST = 1000
#: White space and vertical tab, which Java reads otherwise; inside brackets.
_SPACE, _VTAB = r"\t\n\f\r ", r"\x0B"


class BadPattern(ValueError):
    """A pattern that a linear-time engine refuses."""


def _property(p: str, i: int) -> tuple[str, int]:
    r"""``\p`` or ``\P`` at ``i`` in Java syntax, and where it ends."""
    m = re.compile(r"\\([pP])(?:\{(\^?)([A-Za-z_]+)\}|([A-Z]))").match(p, i)
    if not m:
        raise BadPattern("invalid character class range")
    name = m[3] or m[4]
    if name == "Any":
        inside = r"\x{0}-\x{10FFFF}"
        return (f"[^{inside}]" if (m[1] == "P") != bool(m[2]) else f"[{inside}]"), m.end()
    if name not in _CATEGORIES:
        try:
            regex.compile(rf"\p{{Script={name}}}")
        except regex.error:
            raise BadPattern(f"unknown character class {name}") from None
    sign = "P" if (m[1] == "P") != bool(m[2]) else "p"
    return rf"\{sign}{{{name if name in _CATEGORIES else 'Is' + name}}}", m.end()


def _escape(p: str, i: int, inside: bool) -> tuple[str, int]:
    """The escape at ``i`` in Java syntax, and where it ends; ``inside`` brackets fewer are allowed."""
    if i + 1 == len(p):
        raise BadPattern("trailing backslash")
    n = p[i + 1]
    if n in "pP":
        return _property(p, i)
    if n in "dDwW" or (n in "afnrt"):
        return p[i : i + 2], i + 2
    if n == "s":
        return (_SPACE if inside else f"[{_SPACE}]"), i + 2
    if n == "S":
        return f"[^{_SPACE}]", i + 2
    if n == "v":
        return _VTAB, i + 2
    if not inside and n in "bBAz":
        return p[i : i + 2], i + 2
    if n == "x":
        m = re.compile(r"\\x(?:\{([0-9A-Fa-f]+)\}|([0-9A-Fa-f]{2}))").match(p, i)
        code = int(m[1] or m[2], 16) if m else 0x110000
        if code > 0x10FFFF:
            raise BadPattern("invalid escape sequence \\x")
        return rf"\x{{{code:X}}}", m.end()
    if n in "01234567":
        m = re.compile(r"\\([0-7]{1,3})").match(p, i)
        if n != "0" and len(m[1]) < 2:
            raise BadPattern("back references are not supported")
        return rf"\x{{{int(m[1], 8):X}}}", m.end()
    if n.isascii() and not n.isalnum() and n != "_":
        return p[i : i + 2], i + 2
    raise BadPattern("back references are not supported" if n in "89k" else f"invalid escape sequence \\{n}")


def _literal(c: str) -> str:
    return "\\" + c if c in r"\[]&^-~" or c in "|(){}*+?.$#" else c


def _class(p: str, i: int) -> tuple[str, int]:
    """The bracket expression that begins at ``i``, in Java syntax, and where it ends."""
    j, negative = i + 1, p.startswith("^", i + 1)
    j += negative
    out, first = "", True
    while j < len(p) and (p[j] != "]" or first):
        first = False
        if m := re.compile(r"\[:(\^?)(\w+):\]").match(p, j):
            if m[2] not in _POSIX:
                raise BadPattern(f"unknown character class [:{m[2]}:]")
            out, j = out + (_POSIX[m[2]] if not m[1] else "[^" + _POSIX[m[2]] + "]"), m.end()
            continue
        if p[j] == "\\" and p[j + 1 : j + 2] and p[j + 1] in "dDwWsSpP":
            text, j = _escape(p, j, True)
            out += text
            continue
        low, j = _one(p, j)
        if p.startswith("-", j) and j + 1 < len(p) and p[j + 1] != "]":
            high, j = _one(p, j + 1)
            if _code(high) < _code(low):
                raise BadPattern("invalid character class range")
            out += f"{low}-{high}"
        else:
            out += low
    if j >= len(p):
        raise BadPattern("missing closing ]")
    return ("[^" if negative else "[") + out + "]", j + 1


def _one(p: str, j: int) -> tuple[str, int]:
    """One character of a bracket expression in Java syntax."""
    if p[j] != "\\":
        return _literal(p[j]), j + 1
    text, end = _escape(p, j, True)
    if len(text) > 2 and not text.startswith(r"\x"):
        raise BadPattern("invalid character class range")
    return text, end


def _code(c: str) -> int:
    if c.startswith(r"\x"):
        return int(c[2:].strip("{}"), 16)
    return {"\\a": 7, "\\f": 12, "\\n": 10, "\\r": 13, "\\t": 9}.get(c, ord(c[-1]))


def to_java(pattern: str) -> str:
    """``pattern`` for ``rlike``, matching the whole text.

    Refused are back references, look-around, possessive quantifiers, atomic groups, repeat counts beyond 1,000 (also
    of repeats of repeats), group names given twice, a repetition of nothing or of a change of flags, and the ungreedy flag.
    """
    p, i, out = pattern, 0, ""
    #: Open groups: greatest product of repeats within, of the group so far and of its last operand.
    worst, last, open_groups = 1, 1, []
    operand, quantified, names = False, False, set()
    while i < len(p):
        c = p[i]
        m = re.compile(r"[*+?]|\{(\d+)(,(\d*))?\}").match(p, i)
        if m:
            if quantified:
                raise BadPattern("invalid nested repetition operator")
            if not operand:
                raise BadPattern("missing argument to repetition operator")
            text = m[0]
            if text[0] == "{":
                least, most = int(m[1]), int(m[3] or m[1])
                if max(least, most) > _MOST or (m[3] and most < least) or last * max(least, most, 1) > _MOST:
                    raise BadPattern("invalid repeat count")
                last *= max(least, most, 1)
                worst = max(worst, last)
                # Java reads no leading zeros otherwise; counts are written plainly.
                text = "{" + str(least) + ("" if m[2] is None else "," + (str(most) if m[3] else "")) + "}"
            i = m.end()
            out += text
            if p.startswith("?", i):
                out, i = out + "?", i + 1
            quantified = True
            continue
        quantified = False
        if c == "(":
            if m := re.compile(r"\(\?P?<([^>]*)>").match(p, i):
                if not re.fullmatch(r"\w+", m[1], re.A):
                    raise BadPattern(f"invalid named capture {m[0]}")
                if m[1] in names:
                    raise BadPattern(f"duplicate capture group name {m[1]}")
                names.add(m[1])
                # Java group names are letters and digits only; nothing refers to them.
                out, i = out + f"(?<g{len(names)}>", m.end()
            elif m := re.compile(r"\(\?([imsU]*)(-[imsU]+)?([:)])").match(p, i):
                if "U" in m[0]:
                    raise BadPattern("the ungreedy flag is not supported")
                if m[3] == ")":
                    out, i, operand = out + (m[0] if m[0] != "(?)" else ""), m.end(), False
                    continue
                out, i = out + m[0], m.end()
            elif p.startswith("(?", i):
                raise BadPattern(f"invalid or unsupported Perl syntax {p[i : i + 4]!r}")
            else:
                out, i = out + "(", i + 1
            open_groups.append(worst)
            worst, operand = 1, False
        elif c == ")":
            if not open_groups:
                raise BadPattern("unexpected )")
            last, worst = worst, max(worst, open_groups.pop())
            out, i, operand = out + c, i + 1, True
        elif c == "|":
            out, i, operand = out + c, i + 1, False
        elif p.startswith("\\Q", i):
            end = p.find("\\E", i + 2)
            quoted = p[i + 2 : len(p) if end < 0 else end]
            out, i, operand, last = out + "".join(map(_literal, quoted)), len(p) if end < 0 else end + 2, operand or bool(quoted), 1
        else:
            text, i = _class(p, i) if c == "[" else _escape(p, i, False) if c == "\\" else (c if c in ".^$" else _literal(c), i + 1)
            # A surrogate-free engine sees one character where Java sees one too.
            out, operand, last = out + text, True, 1
    if open_groups:
        raise BadPattern("missing closing )")
    return r"\A(?d)(?:" + out + r")\z"
