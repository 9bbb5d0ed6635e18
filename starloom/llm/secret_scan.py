"""Secret scans in DataFrame expressions only.

Base spans are leftmost non-overlapping matches per kind (assign, access, hex). The method adds spans of high Shannon entropy:
over each candidate string a window of ``WINDOW`` characters slides; the counts of its characters and the sum of c * log2(c) are
updated by the character that enters and the one that leaves. A window counts as ``entropy_hex`` if it is all hexadecimal,
as ``entropy_mixed`` if it has digits, upper and lower case, as ``entropy_lower`` (base36) or ``entropy_upper`` (base32) if it is all
digits and letters of one case, not all hexadecimal, and as ``entropy_letters`` in a piece of letters only, each at its own threshold;
windows that touch make one span.
Windows that overlap an allow-listed part of their candidate (identifiers, alphabets, examples) do not count, and spans that
overlap a base span are left out.

Time grows with the length of a text: candidates are cut into pieces of ``PIECE`` characters (each with the start of the next), and
all positions and spans come from running sums and comparisons of neighbours. A value that several steps need is bound once
(``_let``), as expressions inside lambdas are evaluated wherever they stand. The expressions are made as SQL text, since building
them column by column takes the driver many times as long as running them on a small table.

Positions are code points, ends exclusive. Defined results: null text counts as empty (no spans); other columns pass through,
whatever their names, but for those of the results, which are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame

from .common import fresh

#: The base kinds and their patterns, in the order in which equal starts are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_mixed", "entropy_lower", "entropy_upper", "entropy_letters")

WINDOW = 20
#: Bits a character: of a window of its class.
THRESHOLDS = {"entropy_hex": 3.1, "entropy_mixed": 3.8, "entropy_lower": 3.8, "entropy_upper": 3.8, "entropy_letters": 4.0}
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: Candidates of entropy_letters: whole pieces between other characters, without digits.
LETTERS = r"(?<![A-Za-z0-9])[A-Za-z]{20,}(?![A-Za-z0-9])"
#: Parts of candidates that look random but are not secret.
ALLOW = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|example|abcdefghijkl|0123456789|1234567890|lorem|(.)\1{5}"

#: Characters of a candidate that one fold goes over.
PIECE = 512
#: Elements whose running sum one fold makes.
_GROUP = 256
_RESULTS = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "span_list")


_NAMES = count()


def _text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _over(function: str, array: str, body: Callable[[str], str]) -> str:
    """A higher-order function with a variable of its own."""
    x = f"v{next(_NAMES)}"
    return f"{function}({array}, {x} -> {body(x)})"


def _let(value: str, body: Callable[[str], str]) -> str:
    """body of value, which is evaluated once however often body uses it."""
    return f"get({_over('transform', f'array({value})', body)}, 0)"


def _zip(a: str, b: str, body: Callable[[str, str], str]) -> str:
    x, y = f"v{next(_NAMES)}", f"v{next(_NAMES)}"
    return f"zip_with({a}, {b}, ({x}, {y}) -> {body(x, y)})"


def _together(**arrays: str) -> str:
    """An array of structs of arrays of one length."""
    (first, a), *rest = arrays.items()
    out, names = _over("transform", a, lambda x: _struct(**{first: x})), [first]
    for name, b in rest:
        out = _zip(out, b, lambda x, y, name=name: _struct(**{n: f"{x}.{n}" for n in names}, **{name: y}))
        names.append(name)
    return out


def _fold(array: str, start: str, step: Callable[[str, str], str], end: Callable[[str], str]) -> str:
    acc, x, out = (f"v{next(_NAMES)}" for _ in range(3))
    return f"aggregate({array}, {start}, ({acc}, {x}) -> {step(acc, x)}, {out} -> {end(out)})"


def _struct(**fields: str) -> str:
    return f"named_struct({', '.join(f'{_text(k)}, {v}' for k, v in fields.items())})"


def _empty(kind: str) -> str:
    return f"cast(array() AS array<{kind}>)"


_SUM = "({} + {})".format


def _before(values: str, zero: int = 0, op: Callable[[str, str], str] = _SUM) -> str:
    """op (sum, least or greatest) over all elements before each element, in time near the number of elements."""

    def fold(a: str, base: str) -> str:
        return _fold(a, _struct(at=base, out=_empty("int")), lambda acc, x: _struct(at=op(f"{acc}.at", x), out=f"concat({acc}.out, array({acc}.at))"), lambda acc: f"{acc}.out")

    def grouped(s: str) -> str:
        groups = _over("transform", f"sequence(0, cast(floor((size({s}) - 1) / {_GROUP}) AS int))", lambda g: f"slice({s}, {g} * {_GROUP} + 1, {_GROUP})")
        total = lambda g: _fold(g, str(zero), op, lambda x: x)
        return _let(groups, lambda gs: f"flatten({_zip(gs, fold(_over('transform', gs, total), str(zero)), fold)})")

    return _let(values, lambda s: f"if(size({s}) > 0, {grouped(s)}, {_empty('int')})")


def _matches(text: str, pattern: str, groups: tuple[int, ...] = (), where: str = "true") -> str:
    """array<struct<start, end, match, groups...>> of a pattern's matches; the pieces between them give the positions.

    where: a cheap condition that holds wherever the pattern matches.
    """
    p = _text(pattern)
    kind = f"struct<start:int,end:int,match:string{''.join(f',g{g}:string' for g in groups)}>"

    def placed(found: str) -> str:
        lengths = _zip(f"slice(split({text}, {p}), 1, size({found}))", found, lambda piece, m: _struct(skip=f"length({piece})", n=f"length({m})"))
        starts = _let(lengths, lambda ls: _zip(_before(_over("transform", ls, lambda x: f"{x}.skip + {x}.n")), ls, lambda at, x: f"{at} + {x}.skip"))
        zipped = _together(start=starts, match=found, **{f"g{g}": f"regexp_extract_all({text}, {p}, {g})" for g in groups})
        return _over("transform", zipped, lambda x: _struct(start=f"{x}.start", end=f"{x}.start + length({x}.match)", match=f"{x}.match", **{f"g{g}": f"{x}.g{g}" for g in groups}))

    return f"if({where} AND {text} RLIKE {p}, {_let(f'regexp_extract_all({text}, {p}, 0)', placed)}, {_empty(kind)})"


def _between(m: str, pattern: str) -> str:
    """array<struct<start, match>> of the pieces of a candidate outside a pattern's matches that have room for a window."""
    p = _text(pattern)

    def placed(pieces: str) -> str:
        skips = f"concat({_over('transform', f'regexp_extract_all({m}.match, {p}, 0)', 'length({})'.format)}, array(0))"
        starts = _before(_zip(pieces, skips, lambda piece, n: f"length({piece}) + {n}"))
        return _zip(starts, pieces, lambda at, piece: _struct(start=f"{m}.start + {at}", match=piece))

    cut = f"if({m}.match RLIKE {p}, {_let(f'split({m}.match, {p})', placed)}, array({_struct(start=f'{m}.start', match=f'{m}.match')}))"
    return _over("filter", cut, lambda piece: f"length({piece}.match) >= {WINDOW}")


def _spans(found: str, kind: str, keep: Callable[[str], str] | None = None) -> str:
    kept = _over("filter", found, keep) if keep else found
    return _over("transform", kept, lambda m: _struct(start=f"{m}.start", kind=str(KINDS.index(kind)), end=f"{m}.end"))


_CODE = 42  # "+" is 1 and "z" is 80
_ROOM = 80


def _classes(k: str) -> dict[str, str]:
    """Conditions on a character's code."""
    at = lambda a, z: f"{k} BETWEEN {ord(a) - _CODE} AND {ord(z) - _CODE}"
    return {"uppers": at("A", "Z"), "lowers": at("a", "z"), "digits": at("0", "9"), "hexes": f"({at('0', '9')} OR {at('A', 'F')} OR {at('a', 'f')})"}


def _windows(piece: str, kinds: tuple[str, ...]) -> str:
    """One character for each window of a piece: 48 plus a bit for each kind whose threshold the window passes.

    The state holds the counts of the window's characters as a string of ``_ROOM`` characters ("@" is none, "T" twenty).
    """
    weights = f"array({', '.join(f'{0.0 if c < 2 else c * math.log2(c)!r}D' for c in range(WINDOW + 2))})"
    codes = _over("transform", f"split({piece}, '')", lambda c: f"ascii({c}) - {_CODE}")
    steps = _let(codes, lambda c: _together(new=c, old=f"slice(concat(array_repeat(0, {WINDOW}), {c}), 1, size({c}))"))
    classes = ("uppers", "lowers", "digits", "hexes")
    start = _struct(i="0", counts=_text("@" * _ROOM), total="0D", **dict.fromkeys(classes, "0"), out="''")

    def changed(counts: str, total: str, k: str, by: int) -> str:
        """Counts and total after one character more or less."""
        return _let(f"ascii(substring({counts}, {k}, 1)) - 64", lambda c: _struct(counts=f"overlay({counts} PLACING char({c} + {by + 64}) FROM {k} FOR 1)", total=f"{total} - get({weights}, {c}) + get({weights}, {c} + {by})"))

    def mask(h: str) -> str:
        whole = lambda *c: f"{' + '.join(f'{h}.{x}' for x in c)} = {WINDOW}"
        some = lambda *c: " AND ".join(f"{h}.{x} > 0" for x in c)
        fits = {
            "entropy_hex": f"{whole('hexes')} AND {some('digits')}", "entropy_mixed": some("digits", "uppers", "lowers"),
            "entropy_lower": f"{whole('digits', 'lowers')} AND {some('digits', 'lowers')} AND {h}.hexes < {WINDOW}", "entropy_upper": f"{whole('digits', 'uppers')} AND {some('digits', 'uppers')} AND {h}.hexes < {WINDOW}",
            "entropy_letters": whole("uppers", "lowers"),
        }
        return " + ".join(f"if({h}.bits >= {THRESHOLDS[k] - 1e-12!r}D AND {fits[k]}, {1 << b}, 0)" for b, k in enumerate(kinds))

    def step(acc: str, x: str) -> str:
        def out(now: str) -> str:
            come, left = _classes(f"{x}.new"), _classes(f"{x}.old")
            have = _struct(**{c: f"{acc}.{c} + if({come[c]}, 1, 0) - if({left[c]}, 1, 0)" for c in classes}, bits=f"{math.log2(WINDOW)!r}D - {now}.total / {WINDOW}")
            return _let(have, lambda h: _struct(i=f"{acc}.i + 1", counts=f"{now}.counts", total=f"{now}.total", **{c: f"{h}.{c}" for c in classes}, out=f"if({acc}.i < {WINDOW - 1}, '', concat({acc}.out, char(48 + {mask(h)})))"))

        gone = f"if({x}.old > 0, {changed(f'{acc}.counts', f'{acc}.total', f'{x}.old', -1)}, {_struct(counts=f'{acc}.counts', total=f'{acc}.total')})"
        return _let(gone, lambda rest: _let(changed(f"{rest}.counts", f"{rest}.total", f"{x}.new", 1), out))

    return _fold(steps, start, step, lambda acc: f"{acc}.out")


def _touching(starts: str) -> str:
    """array<struct<from, to>> of ascending window starts: windows that overlap or touch make one span."""
    x, y, i, j = (f"v{next(_NAMES)}" for _ in range(4))
    first = lambda s: f"filter({s}, ({x}, {i}) -> {i} = 0 OR {x} > get({s}, {i} - 1) + {WINDOW})"
    last = lambda s: f"filter({s}, ({y}, {j}) -> {j} = size({s}) - 1 OR {y} + {WINDOW} < get({s}, {j} + 1))"
    return _let(starts, lambda s: _zip(first(s), last(s), lambda a, b: _struct(**{"from": a, "to": f"{b} + {WINDOW}"})))


def _entropy_spans(m: str, kinds: tuple[str, ...]) -> str:
    """array of spans of these kinds in one candidate (start, match)."""
    heads = lambda ps: f"concat({_over('transform', f'slice({ps}, 2, size({ps}))', lambda p: f'left({p}, {WINDOW - 1})')}, array(''))"
    overlapping = _let(f"regexp_extract_all({m}.match, {_text('(?s).{1,%d}' % PIECE)}, 0)", lambda ps: _zip(ps, heads(ps), lambda p, head: f"concat({p}, {head})"))
    masks = f"split(array_join({_over('transform', overlapping, lambda p: _windows(p, kinds))}, ''), '')"
    c, i = f"v{next(_NAMES)}", f"v{next(_NAMES)}"
    high = _over("filter", f"transform({masks}, ({c}, {i}) -> {_struct(at=i, bits=f'ascii({c}) - 48')})", lambda w: f"{w}.bits > 0")

    def of(open_: str, bit: int, kind: str) -> str:
        own = _over("transform", _over("filter", open_, lambda w: f"({w}.bits & {1 << bit}) > 0"), lambda w: f"{w}.at")
        return _over("transform", _touching(own), lambda s: _struct(start=f"{m}.start + {s}.from", kind=str(KINDS.index(kind)), end=f"{m}.start + {s}.to"))

    return _let(high, lambda open_: f"concat({', '.join(of(open_, b, k) for b, k in enumerate(kinds))})")


def _searched(candidates: str, kinds: tuple[str, ...]) -> str:
    """The spans of each piece of a candidate outside its allow-listed parts."""
    return _over("transform", f"flatten({_over('transform', candidates, lambda m: _between(m, ALLOW))})", lambda m: _entropy_spans(m, kinds))


def _apart(added: str, base: str) -> str:
    """The added spans that overlap no base span: neither one that starts before them nor the next one."""
    most = (1 << 31) - 1
    event = lambda own: lambda s: _struct(start=f"{s}.start", own=str(own), end=f"{s}.end", kind=f"{s}.kind")
    events = f"array_sort(concat({_over('transform', base, event(0))}, {_over('transform', added, event(1))}))"

    def kept(es: str) -> str:
        reach = _before(_over("transform", es, lambda e: f"if({e}.own = 0, {e}.end, 0)"), 0, "greatest({}, {})".format)
        ahead = f"reverse({_before(_over('transform', f'reverse({es})', lambda e: f'if({e}.own = 0, {e}.start, {most})'), most, 'least({}, {})'.format)})"
        free = _over("filter", _together(e=es, reach=reach, ahead=ahead), lambda x: f"{x}.e.own = 1 AND {x}.reach <= {x}.e.start AND {x}.ahead >= {x}.e.end")
        return _over("transform", free, lambda x: _struct(start=f"{x}.e.start", kind=f"{x}.e.kind", end=f"{x}.e.end"))

    return f"if(size({base}) > 0 AND size({added}) > 0, {_let(events, kept)}, {added})"


def _listed(spans: str) -> str:
    kinds = f"array({', '.join(map(_text, KINDS))})"
    return f"array_join({_over('transform', f'array_sort({spans})', lambda s: f'concat_ws({_text(":")}, get({kinds}, {s}.kind), {s}.start, {s}.end)')}, ',')"


def scan(docs: DataFrame) -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256, spans (text) and span_list (array of start, kind, end)."""
    names = [c for c in docs.columns if c.lower() not in _RESULTS]
    t, assign, access, hexes, candidates, letters, base, added, spans = (fresh([*names, *_RESULTS], c) for c in ("text_", "assign_", "access_", "hex_", "candidates_", "letters_", "base_", "added_", "spans_"))
    keyword = " OR ".join(f"contains(lower({t}), '{w}')" for w in ("passw", "secret", "token", "api"))
    long_run = f"size({candidates}) > 0"  # every hex span and every piece of letters lies in a candidate
    likely = _over("filter", candidates, lambda m: f"{m}.match RLIKE '[0-9]' AND {m}.match RLIKE '[A-Za-z]'")
    *digits, only = THRESHOLDS
    found = f"flatten(concat({_searched(likely, tuple(digits))}, {_searched(letters, (only,))}))"
    steps = [
        {candidates: _matches(t, CANDIDATE)},
        {
            assign: _spans(_matches(t, ASSIGN, (2,), f"({keyword})"), "assign", lambda m: f"length({m}.g2) >= 6"), access: _spans(_matches(t, ACCESS, where=f"contains({t}, 'AKIA')"), "access"),
            hexes: _spans(_matches(t, HEX, where=long_run), "hex"), letters: _matches(t, LETTERS, where=long_run),
        },
        {base: f"concat({assign}, {access}, {hexes})", added: f"if({long_run}, {found}, {_empty('struct<start:int,kind:int,end:int>')})"},
        {spans: f"array_sort(concat({base}, {_apart(added, base)}))"},
    ]
    own = [f"`{c.replace('`', '``')}`" for c in names]
    out = docs.selectExpr(*own, f"coalesce(cast(text AS string), '') AS {t}")
    for step in steps:
        out = out.selectExpr("*", *(f"{e} AS {c}" for c, e in step.items()))
    size = lambda c: f"cast(size({c}) AS long)"
    return out.selectExpr(*own, f"{size(assign)} AS n_assign", f"{size(access)} AS n_access", f"{size(hexes)} AS n_hex", f"sha2({_listed(base)}, 256) AS base_sha256", f"{_listed(spans)} AS spans", f"{spans} AS span_list")
