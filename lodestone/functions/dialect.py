r"""Patterns of a finite-automaton dialect (RE2 and its kin) for Java's engine: parsed, then written anew.

The dialect has no look-around and no back-references; its classes and case are Unicode, "." stops at
\n alone, $ is the text's end, classes nest and know set operations, and flags hold to the end of
their group. A pattern becomes a tree first, so that each piece is written under the flags that hold
there; Java's own flags are off but for (?dU), and what they would mean is spelled out. What has no
equal is refused, and never passed on to mean something else.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace


class BadPattern(ValueError):
    """A pattern that the source dialect does not allow, or that has no equal in Java."""


@dataclass(frozen=True)
class Flags:
    """i: any case; m: ^ and $ at lines; s: "." is \\n too; x: blanks and comments don't count; and nothing else: R and U are refused."""

    i: bool = False
    m: bool = False
    s: bool = False
    x: bool = False


@dataclass
class Node:
    """kind: "any", "text", "class", "start", "end", "edge", "all" (one after another), "or", "group", "repeat"."""

    kind: str
    flags: Flags = field(default_factory=Flags)
    value: object = None
    parts: list[Node] = field(default_factory=list)


# The dialect's ASCII classes, by ranges.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t-\r ", "upper": "A-Z", "word": r"0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
#: Escapes of single characters.
_CONTROL = {"a": 7, "f": 12, "t": 9, "n": 10, "r": 13, "v": 11}
_META = set("\\.+*?()|[]{}^$#&-~/\"'!%,:;<=>@`_ ")
_CLASSES = "dDsSwW"


def char(code: int) -> str:
    """A character as both a class and a sequence in Java can have it."""
    if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF:
        raise BadPattern(f"no such character: {code:x}")
    c = chr(code)
    return c if c.isascii() and c.isalnum() else rf"\x{{{code:X}}}"


class Parser:
    """Recursive descent: alternatives, sequences, repeats, atoms; classes by rules of their own."""

    def __init__(self, pattern: str):
        self.text, self.at, self.names = pattern, 0, set()

    def peek(self, n: int = 1) -> str:
        return self.text[self.at : self.at + n]

    def take(self, n: int = 1) -> str:
        got = self.peek(n)
        if len(got) < n:
            raise BadPattern("the pattern ends too soon")
        self.at += n
        return got

    def eat(self, text: str) -> bool:
        if self.text.startswith(text, self.at):
            self.at += len(text)
            return True
        return False

    def parse(self) -> Node:
        tree, _ = self.alternatives(Flags())
        if self.at < len(self.text):
            raise BadPattern("an unopened group")
        return tree

    def alternatives(self, flags: Flags) -> tuple[Node, Flags]:
        """Flags that a branch sets hold for the branches after it, too."""
        branches = []
        while True:
            branch, flags = self.sequence(flags)
            branches.append(branch)
            if not self.eat("|"):
                return (branches[0] if len(branches) == 1 else Node("or", flags, parts=branches)), flags

    def sequence(self, flags: Flags) -> tuple[Node, Flags]:
        parts: list[Node] = []
        while self.at < len(self.text) and self.peek() not in "|)":
            if flags.x and self._blank():
                continue
            if self.text.startswith("(?", self.at) and (flagged := re.compile(r"\(\?([a-zA-Z]*)(-([a-zA-Z]*))?\)").match(self.text, self.at)):
                flags = self._flags(flags, flagged[1], flagged[3], flagged[2])
                self.at = flagged.end()
                continue
            c = self.peek()
            if c in "*+?" or c == "{" and self._counts(False):
                if not parts:
                    raise BadPattern("nothing to repeat")
                parts.append(self.repeat(parts.pop(), flags))
            else:
                parts.append(self.atom(flags))
        return (parts[0] if len(parts) == 1 else Node("all", flags, parts=parts)), flags

    def _blank(self) -> bool:
        if self.peek().isspace():
            self.at += 1
        elif self.peek() == "#":
            end = self.text.find("\n", self.at)
            self.at = len(self.text) if end < 0 else end + 1
        else:
            return False
        return True

    def _flags(self, flags: Flags, on: str, off: str | None, minus: str | None) -> Flags:
        if not on and not off:
            raise BadPattern("flags without a flag")
        if minus and not off:
            raise BadPattern("no flag after -")
        for names, value in ((on or "", True), (off or "", False)):
            for n in names:
                if n == "u":
                    if not value:
                        raise BadPattern("bytes instead of characters are not supported")
                elif n in "imsx":
                    flags = replace(flags, **{n: value})
                else:
                    raise BadPattern(f"flag {n} is not supported")
        return flags

    def _counts(self, take: bool):
        found = re.compile(r"\{\s*(\d+)\s*(,\s*(\d*)\s*)?\}").match(self.text, self.at)
        if found and take:
            self.at = found.end()
        return found

    def repeat(self, what: Node, flags: Flags) -> Node:
        if what.kind == "repeat":
            what = Node("group", flags, ("(?:",), [what])
        if self.peek() == "{":
            found = self._counts(True)
            low, high = int(found[1]), int(found[1]) if found[2] is None else int(found[3]) if found[3] else None
            if high is not None and high < low or low > 1000 or (high or 0) > 1000:
                raise BadPattern("counts out of order, or too great")
            times = f"{{{low}}}" if found[2] is None else f"{{{low},{'' if high is None else high}}}"
        else:
            times = self.take()
        lazy = self.eat("?")
        if self.peek() == "+":
            raise BadPattern("possessive quantifiers are not supported")
        return Node("repeat", flags, times + ("?" if lazy else ""), [what])

    def atom(self, flags: Flags) -> Node:
        c = self.take()
        if c == ".":
            return Node("any", flags)
        if c in "^$":
            return Node("start" if c == "^" else "end", flags)
        if c == "(":
            return self.group(flags)
        if c == "[":
            return Node("class", flags, self.klass(flags))
        if c == "\\":
            return self.escape(flags)
        if c == "{":
            raise BadPattern("a count that is none")
        return Node("text", flags, char(ord(c)))

    def group(self, flags: Flags) -> Node:
        opening = "("
        if self.eat("?"):
            if self.peek() in ("=", "!", ">") or self.peek(2) in ("<=", "<!"):
                raise BadPattern("look-around and atomic groups are not supported")
            named = re.compile(r"P?<([A-Za-z_][A-Za-z0-9_.\[\]]*)>").match(self.text, self.at)
            if named:
                if named[1] in self.names or not named[1].isalnum():
                    raise BadPattern(f"group name {named[1]}: repeated, or with characters that Java's names can't have")
                self.names.add(named[1])
                opening, self.at = f"(?<{named[1]}>", named.end()
            else:
                found = re.compile(r"([a-zA-Z]*)(-([a-zA-Z]*))?:").match(self.text, self.at)
                if not found:
                    raise BadPattern("an unknown kind of group")
                if found.end() - self.at > 1:
                    flags = self._flags(flags, found[1], found[3], found[2])
                opening, self.at = "(?:", found.end()
        inner, _ = self.alternatives(flags)
        if not self.eat(")"):
            raise BadPattern("an open group")
        return Node("group", flags, (opening,), [inner])

    def number(self, digits: int) -> int:
        """The code after \\x, \\u or \\U: so many digits, or any in braces."""
        found = re.compile(rf"\{{([0-9A-Fa-f]+)\}}|([0-9A-Fa-f]{{{digits}}})").match(self.text, self.at)
        if not found:
            raise BadPattern("a code without digits")
        self.at = found.end()
        return int(found[1] or found[2], 16)

    def single(self, c: str) -> int | None:
        """The code of an escape that is one character; None: it is not."""
        if c in _CONTROL:
            return _CONTROL[c]
        if c in "xuU":
            return self.number({"x": 2, "u": 4, "U": 8}[c])
        if c in _META and c not in "<>":
            return ord(c)
        return None

    def property_(self, negated: bool) -> str:
        found = re.compile(r"\{(\^?)([A-Za-z_ ]+)\s*([=:]|!=)?\s*([A-Za-z_ ]*)\}|([A-Z])").match(self.text, self.at)
        if not found:
            raise BadPattern("a property without a name")
        self.at = found.end()
        if found[1] or found[3] == "!=":
            negated = not negated
        name, value = found[5] or found[2].strip(), (found[4] or "").strip()
        if found[3]:
            kind = {"script": "IsScript", "sc": "IsScript", "generalcategory": "", "gc": ""}.get(name.replace("_", "").lower())
            if kind is None or not value:
                raise BadPattern(f"unknown property {name}")
            name = f"script={value}" if kind else value
        elif len(name) > 2:
            name = f"Is{name}"
        return rf"\{'P' if negated else 'p'}{{{name}}}"

    def escape(self, flags: Flags) -> Node:
        c = self.take()
        if c in "bB" and self.peek() == "{":
            raise BadPattern("half word boundaries are not supported")
        if c in "AzbB":
            return Node("edge", flags, {"A": r"\A", "z": r"\z", "b": _BOUNDARY, "B": _NO_BOUNDARY}[c])
        if c in _CLASSES:
            return Node("class", flags, rf"\{c}")
        if c in "pP":
            return Node("class", flags, self.property_(c == "P"))
        if c.isdigit() or c in "kg":
            raise BadPattern("back-references and octal codes are not supported")
        if (code := self.single(c)) is None:
            raise BadPattern(f"unknown escape \\{c}")
        return Node("text", flags, char(code))

    def klass(self, flags: Flags) -> str:
        r"""A class after its "[", as Java's class. Operators bind alike, from left to right: && both, -- without, ~~ only one."""
        negated = self.eat("^")
        left, op = self._items(flags, True), None
        while not self.eat("]"):
            op = self.take(2)
            right = self._items(flags, False)
            if op == "&&":
                left = f"[{left}&&{right}]"
            elif op == "--":
                left = f"[{left}&&[^{right}]]"
            else:
                left = f"[[{left}{right}]&&[^[{left}&&{right}]]]"
        return f"[^{left}]" if negated else f"[{left}]"

    def _items(self, flags: Flags, first: bool) -> str:
        """Members up to an operator or the class's end, in brackets."""
        out: list[str] = []
        while True:
            if self.at >= len(self.text):
                raise BadPattern("an open class")
            if self.peek(2) in ("&&", "--", "~~") and not (first and self.peek(2) == "--" and not out):
                break
            if self.peek() == "]" and (out or not first):
                break
            if flags.x and self.peek().isspace():
                self.at += 1
                continue
            if self.peek() == "[":
                posix = re.compile(r"\[:(\^?)([a-z]+):\]").match(self.text, self.at)
                if posix:
                    if posix[2] not in POSIX:
                        raise BadPattern(f"unknown class {posix[2]}")
                    self.at = posix.end()
                    out.append(f"[{posix[1]}{POSIX[posix[2]]}]")
                else:
                    self.at += 1
                    out.append(self.klass(flags))
                continue
            low = self._member()
            if self.peek() == "-" and self.peek(2) not in ("--", "-]") and len(self.peek(2)) == 2:
                self.at += 1
                high = self._member()
                if not isinstance(low, int) or not isinstance(high, int) or high < low:
                    raise BadPattern("a range that is none")
                out.append(f"{char(low)}-{char(high)}")
            else:
                out.append(char(low) if isinstance(low, int) else low)
        if not out:
            raise BadPattern("an empty class")
        return f"[{''.join(out)}]"

    def _member(self) -> int | str:
        c = self.take()
        if c != "\\":
            return ord(c)
        c = self.take()
        if c in _CLASSES:
            return rf"\{c}"
        if c in "pP":
            return self.property_(c == "P")
        if (code := self.single(c)) is None:
            raise BadPattern(f"unknown escape \\{c} in a class")
        return code


# Between a word's character and another one, or an edge of the text; Java's own follows other rules.
_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_NO_BOUNDARY = r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"


def written(node: Node) -> str:
    """A tree in Java's syntax; flags stand at the pieces that they change."""
    f = node.flags
    if node.kind == "any":
        return r"[\x{0}-\x{10FFFF}]" if f.s else r"[^\n]"
    if node.kind in ("text", "class"):
        return f"(?i:{node.value})" if f.i else node.value
    if node.kind == "start":
        return r"(?:\A|(?<=\n))" if f.m else r"\A"
    if node.kind == "end":
        return r"(?:\z|(?=\n))" if f.m else r"\z"
    if node.kind == "edge":
        return node.value
    if node.kind == "all":
        return "".join(map(written, node.parts))
    if node.kind == "or":
        return f"(?:{'|'.join(map(written, node.parts))})"
    if node.kind == "group":
        return f"{node.value[0]}{written(node.parts[0])})"
    inner = written(node.parts[0])
    return f"{inner if node.parts[0].kind in ('any', 'group') else f'(?:{inner})'}{node.value}"


def to_java(pattern: str) -> str:
    """pattern as Java reads it; BadPattern if there is no such thing."""
    return "(?dU)" + written(Parser(pattern).parse())
