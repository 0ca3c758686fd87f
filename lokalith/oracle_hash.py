"""CityHash64 over the UTF-16 units of a text, written in SQL: numbers below 2^64 multiplied as 128-bit ones, blocks folded by a list."""

from __future__ import annotations

from itertools import count

_NAMES = count()
_M = "CAST('18446744073709551616' AS UHUGEINT)"
K0, K1, K2, K_MUL = (f"CAST('{x}' AS UBIGINT)" for x in (0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F, 0x9DDFEA08EB382D69))


def _let(value: str, body) -> str:
    """``body`` of a name for ``value``, which is so computed once."""
    name = f"t{next(_NAMES)}"
    return f"list_transform([{value}], lambda {name}: {body(name)})[1]"


def _mul(a: str, b: str) -> str:
    return f"CAST((CAST({a} AS UHUGEINT) * CAST({b} AS UHUGEINT)) % {_M} AS UBIGINT)"


def _add(*xs: str) -> str:
    return "CAST((" + " + ".join(f"CAST({x} AS UHUGEINT)" for x in xs) + f") % {_M} AS UBIGINT)"


def _rot(x: str, n: int) -> str:
    return _let(x, lambda t: f"(({t} >> {n}) | {_mul(t, str(1 << (64 - n)))})")


def _mix(x: str) -> str:
    return _let(x, lambda t: f"xor({t}, {t} >> 47)")


def _swap(x: str) -> str:
    return _let(x, lambda t: _add(*[_mul(f"(({t} >> {8 * k}) & 255)", str(1 << (56 - 8 * k))) for k in range(8)]))


def _pair(u: str, v: str, mul: str = K_MUL) -> str:
    def of(a: str, b: str) -> str:
        return _let(_mix(_mul(f"xor({a}, {b})", mul)), lambda c: _mul(_mix(_mul(f"xor({b}, {c})", mul)), mul))

    return _let(u, lambda a: _let(v, lambda b: of(a, b)))


def _word(at: str, width: int = 8) -> str:
    return f"CAST('0x' || substr(r, 2 * (n - ({at}) - {width}) + 1, {2 * width}) AS UBIGINT)"  # r: the bytes in hex, the last one first


def _end(back: int, width: int = 8) -> str:
    return _word(f"n - {back}", width)


_MUL = _add(K2, "2 * n")


def _short() -> str:
    tiny = _mul(_mix(f"xor({_mul(_add(_word('0', 1), _word('n >> 1', 1) + ' * 256'), K2)}, {_mul(_add('n', _end(1, 1) + ' * 4'), K0)})"), K2)
    small = _pair(_add("n", f"{_word('0', 4)} * 8"), _end(4, 4), _MUL)

    def middle(a: str, b: str) -> str:
        return _pair(_add(_mul(_rot(b, 37), _MUL), a), _mul(_add(_rot(a, 25), b), _MUL), _MUL)

    eight = _let(_add(_word("0"), K2), lambda a: _let(_end(8), lambda b: middle(a, b)))
    return f"CASE WHEN n <= 3 THEN {tiny} WHEN n <= 7 THEN {small} ELSE {eight} END"


def _up_to_32() -> str:
    def of(a: str, b: str, c: str, d: str) -> str:
        return _pair(_add(_rot(_add(a, b), 43), _rot(c, 30), d), _add(a, _rot(_add(b, K2), 18), c), _MUL)

    return _let(_mul(_word("0"), K1), lambda a: _let(_word("8"), lambda b: _let(_mul(_end(8), _MUL), lambda c: of(a, b, c, _mul(_end(16), K2)))))


def _up_to_64() -> str:
    e, f, g, h = _mul(_word("16"), K2), _mul(_word("24"), "9"), _end(8), _mul(_end(16), _MUL)
    a, b, c, d = _mul(_word("0"), K2), _word("8"), _end(24), _end(32)

    def named(values: list[str], body, names: tuple = ()) -> str:
        return body(*names) if not values else _let(values[0], lambda t: named(values[1:], body, (*names, t)))

    def whole(a, b, c, d, e, f, g, h) -> str:
        p = _add(_rot(_add(a, g), 43), _mul(_add(_rot(b, 30), c), "9"))
        q = _add(f"xor({_add(a, g)}, {d})", f, "1")

        def more(p: str, q: str) -> str:
            r = _add(_swap(_mul(_add(p, q), _MUL)), h)
            s = _add(_rot(_add(e, f), 42), c)

            def last(r: str, s: str) -> str:
                t = _mul(_add(_swap(_mul(_add(q, r), _MUL)), g), _MUL)
                z = _add(e, f, c)
                x = _add(_swap(_add(_mul(_add(s, z), _MUL), t)), b)
                return _add(_mul(_mix(_add(_mul(_add(z, x), _MUL), d, h)), _MUL), s)

            return named([r, s], last)

        return named([p, q], more)

    return named([a, b, c, d, e, f, g, h], whole)


def _weak(words: list[str], a: str, b: str, body) -> str:
    """``body`` of the two halves of the weak hash of four words with two seeds."""

    def of(a1: str, last: str) -> str:
        def then(b1: str, a2: str) -> str:
            return body(_add(a2, last), _add(b1, _rot(a2, 44), a1))

        return _let(_rot(_add(b, a1, last), 21), lambda b1: _let(_add(a1, words[1], words[2]), lambda a2: then(b1, a2)))

    return _let(_add(a, words[0]), lambda a1: _let(words[3], lambda last: of(a1, last)))


def _start() -> str:
    """State ``[x, y, z, v0, v1, u0, u1]`` before the first block."""
    four = lambda back: [_end(back - 8 * k) for k in range(4)]

    def with_z(x: str, y: str, z: str) -> str:
        return _weak(four(64), "n", z, lambda v0, v1: _weak(four(32), _add(y, K1), x, lambda u0, u1: f"[{_add(_mul(x, K1), _word('0'))}, {y}, {z}, {v0}, {v1}, {u0}, {u1}]"))

    return _let(_end(40), lambda x: _let(_add(_end(16), _end(56)), lambda y: _let(_pair(_add(_end(48), "n"), _end(24)), lambda z: with_z(x, y, z))))


def _step() -> str:
    """The state ``s`` after a block of eight words ``w``."""

    def of(x: str, y: str, z: str) -> str:
        words = [f"w[{k + 1}]" for k in range(8)]
        return _weak(words[:4], _mul("s[5]", K1), _add(x, "s[6]"), lambda v0, v1: _weak(words[4:], _add(z, "s[7]"), _add(y, "w[3]"), lambda u0, u1: f"[{z}, {y}, {x}, {v0}, {v1}, {u0}, {u1}]"))

    x = f"xor({_mul(_rot(_add('s[1]', 's[2]', 's[4]', 'w[2]'), 37), K1)}, s[7])"
    y = _add(_mul(_rot(_add("s[2]", "s[5]", "w[7]"), 42), K1), "s[4]", "w[6]")
    z = _mul(_rot(_add("s[3]", "s[6]"), 33), K1)
    return _let(x, lambda a: _let(y, lambda b: _let(z, lambda c: of(a, b, c))))


def fallback_sql(table: str, key: str, text: str) -> str:
    """``key, key_hash``: the upper half of the hash of a text, 0 for an empty one."""
    units = f"list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) > 65535 THEN [55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)] ELSE [unicode(c)] END)"
    digits = "array_to_string(list_reverse(list_transform(flatten(u), lambda x: format('{:04X}', CAST(x AS BIGINT)))), '')"
    cut = "list_reverse(regexp_extract_all(substr(r, 2 * (n - 64 * ((n - 1) // 64)) + 1), '.{128}'))"  # blocks are cut once, as each substr looks at its whole text
    blocks = f"list_transform({cut}, lambda k: list_transform(range(8), lambda j: CAST('0x' || substr(k, 2 * (56 - 8 * j) + 1, 16) AS UBIGINT)))"
    final = _pair(_add(_pair("s[4]", "s[6]"), _mul(_mix("s[2]"), K1), "s[3]"), _add(_pair("s[5]", "s[7]"), "s[1]"))
    return f"""
WITH u AS (SELECT {key}, {units} AS u FROM {table} WHERE {text} <> ''),
o AS (SELECT {key}, {digits} AS r FROM u), t AS (SELECT {key}, r, CAST(length(r) // 2 AS BIGINT) AS n FROM o),
states AS (SELECT {key}, list_reduce(list_prepend({_start()}, {blocks}), lambda s, w: {_step()}) AS s FROM t WHERE n > 64),
h AS (SELECT {key}, {_short()} AS h FROM t WHERE n <= 16 UNION ALL SELECT {key}, {_up_to_32()} FROM t WHERE n > 16 AND n <= 32
      UNION ALL SELECT {key}, {_up_to_64()} FROM t WHERE n > 32 AND n <= 64 UNION ALL SELECT {key}, {final} FROM states)
SELECT {key}, CAST(h >> 32 AS BIGINT) AS key_hash FROM h UNION ALL SELECT {key}, 0 FROM {table} WHERE coalesce({text}, '') = ''"""
