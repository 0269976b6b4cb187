"""SQL pieces from which the expected results of the catalogue are put together."""

from __future__ import annotations

from setweave.functions.dna import BASES, LETTERS

K, M, Z, G = 15, 9, 6, 5
SEED = 42

DNA = f"""dna AS (SELECT doc_id, source, regexp_replace(translate(lower(coalesce(text, '')), '{LETTERS}', '{BASES}'), '[^ACGT.]', '', 'g') AS seq FROM documents)"""

SIDES = """sided AS (
  SELECT 'i' AS side, doc_id, source, seq FROM dna WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
  UNION ALL SELECT 'j', doc_id, source, seq FROM dna WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0))"""


def windows(name: str, k: int, table: str = "dna", keep: str = "doc_id, source") -> str:
    """(keep, pos, token) of all runs of k bases."""
    return f"""{name} AS (SELECT * FROM (
  SELECT {keep}, p - 1 AS pos, substr(seq, p, {k}) AS token FROM (SELECT *, unnest(range(1, length(seq) - {k} + 2)) AS p FROM {table} WHERE length(seq) >= {k}))
  WHERE NOT contains(token, '.'))"""


def revcomp(t: str) -> str:
    return f"reverse(translate({t}, 'ACGT', 'TGCA'))"


def canonical(t: str) -> str:
    return f"least({t}, {revcomp(t)})"


def code(t: str, n: int) -> str:
    """Two bits a base."""
    return "(" + " + ".join(f"(strpos('ACGT', substr({t}, {i + 1}, 1)) - 1) * {4 ** (n - 1 - i)}" for i in range(n)) + ")"


def mix_steps(name: str, source: str, column: str, bases: int, keep: str = "*", seed: int = SEED) -> str:
    """CTEs that add ``h``, the integer hash of ``column``."""
    m = (1 << 2 * bases) - 1
    low = f"{name}_0 AS (SELECT {keep}, ({column} + {seed}) & {m} AS x FROM {source})"
    steps = [
        f"((({m} - x) & {m}) + ((x << 21) & {m})) & {m}" if 2 * bases + 21 < 63 else f"((({m} - x) & {m}) + (((x & {(1 << max(0, 2 * bases - 21)) - 1}) << 21) & {m})) & {m}",
        "xor(x, x >> 24)",
        f"(x * 265) & {m}" if 2 * bases + 9 < 63 else "",
        "xor(x, x >> 14)",
        f"(x * 21) & {m}",
        "xor(x, x >> 28)",
        f"(x + (((x & {(1 << max(0, 2 * bases - 31)) - 1}) << 31) & {m})) & {m}",
    ]
    out, before = [low], f"{name}_0"
    for i, s in enumerate(steps, 1):
        out.append(f"{name}_{i} AS (SELECT * EXCLUDE x, {s} AS x FROM {before})")
        before = f"{name}_{i}"
    out.append(f"{name} AS (SELECT * EXCLUDE x, x AS h FROM {before})")
    return ",\n".join(out)


def hashed_mers(name: str, m: int, table: str = "dna", keep: str = "doc_id, source, seq") -> str:
    """(keep, pos, h, run): the hash of each m-mer and the run of bases that it is in."""
    return ",\n".join([
        windows(f"{name}_w", m, table, keep),
        f"{name}_d AS (SELECT DISTINCT token FROM {name}_w)",
        f"{name}_c AS (SELECT token, least({code('token', m)}, {code(revcomp('token'), m)})::BIGINT AS c FROM {name}_d)",
        mix_steps(f"{name}_h", f"{name}_c", "c", m, "token"),
        f"{name} AS (SELECT w.* EXCLUDE token, h.h, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM {name}_w w JOIN {name}_h h USING (token))",
    ])


def minimizers(name: str, m: int, w: int, keep: str = "doc_id, source, seq") -> str:
    """(keep, pos) of minimizers: every smallest of a window of w m-mers; of a run without a window, the last smallest."""
    return ",\n".join([
        hashed_mers(f"{name}_m", m, keep=keep),
        f"""{name}_n AS (SELECT *, CASE WHEN count(*) OVER f = {w} THEN min(h) OVER f END AS least, count(*) OVER (PARTITION BY doc_id, run) AS n
  FROM {name}_m WINDOW f AS (PARTITION BY doc_id, run ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING))""",
        f"""{name}_o AS (SELECT *, max(least) OVER (PARTITION BY doc_id, run ORDER BY pos ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS best,
  row_number() OVER (PARTITION BY doc_id, run ORDER BY h, pos DESC) AS place FROM {name}_n)""",
        f"{name} AS (SELECT {keep}, pos FROM {name}_o WHERE CASE WHEN n >= {w} THEN h = best ELSE place = 1 END)",
    ])


def syncmers(name: str, k: int, z: int, keep: str = "doc_id, source, seq", table: str = "dna") -> str:
    """(keep, pos) of k-mers whose first or last z-mer has the smallest hash."""
    w = k - z + 1
    return ",\n".join([
        hashed_mers(f"{name}_m", z, table, keep),
        f"""{name}_n AS (SELECT *, min(h) OVER f AS least, count(*) OVER f AS n, last(h) OVER f AS newest
  FROM {name}_m WINDOW f AS (PARTITION BY doc_id, run ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING))""",
        f"{name} AS (SELECT {keep}, pos FROM {name}_n WHERE n = {w} AND (h = least OR newest = least))",
    ])


def segments(name: str, cuts: str, k: int) -> str:
    return f"""{name} AS (
  SELECT doc_id, source, a AS pos, substr(seq, a + 1, b - a) AS token FROM (
    SELECT d.doc_id, d.source, d.seq, coalesce(lag(c.pos) OVER o, 0) AS a, c.pos AS b FROM dna d JOIN {cuts} c USING (doc_id) WINDOW o AS (PARTITION BY d.doc_id ORDER BY c.pos)
    UNION ALL
    SELECT d.doc_id, d.source, d.seq, coalesce(max(c.pos), 0), length(d.seq) FROM dna d LEFT JOIN {cuts} c USING (doc_id) WHERE d.seq <> '' GROUP BY ALL)
  WHERE b - a <= {k})"""


M64, M32 = 1 << 64, (1 << 32) - 1
C1, C2, F1, F2 = 0x87C37B91114253D5, 0x4CF5AD432745937F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def _u(x: int) -> str:
    return f"{x}::UHUGEINT"


def _rot(x: str, r: int) -> str:
    return f"(({x} * {_u(1 << r)}) % {_u(M64)} + {x} // {_u(1 << (64 - r))})"


def murmur_x64(name: str, source: str, low: str, high: str | None, length: int, seed: str, keep: str) -> str:
    """CTEs that add ``lo``, the low word of the x64 hash of up to 15 bytes: ``low`` the first eight, ``high`` the rest, little-endian."""
    out = [f"{name}_0 AS (SELECT {keep}, (({low})::UHUGEINT * {_u(C1)}) % {_u(M64)} AS k, " + (f"(({high})::UHUGEINT * {_u(C2)}) % {_u(M64)}" if high else "0::UHUGEINT") + f" AS g, ({seed})::UHUGEINT AS s FROM {source})"]
    steps = [
        f"({_rot('k', 31)} * {_u(C2)}) % {_u(M64)} AS k, ({_rot('g', 33)} * {_u(C1)}) % {_u(M64)} AS g, s",
        f"xor(xor(s, k), {_u(length)}) AS k, xor(xor(s, g), {_u(length)}) AS g, s",
        f"(k + g) % {_u(M64)} AS k, (k + 2::UHUGEINT * g) % {_u(M64)} AS g, s",
        f"(xor(k, k // {_u(1 << 33)}) * {_u(F1)}) % {_u(M64)} AS k, (xor(g, g // {_u(1 << 33)}) * {_u(F1)}) % {_u(M64)} AS g, s",
        f"(xor(k, k // {_u(1 << 33)}) * {_u(F2)}) % {_u(M64)} AS k, (xor(g, g // {_u(1 << 33)}) * {_u(F2)}) % {_u(M64)} AS g, s",
        f"xor(k, k // {_u(1 << 33)}) AS k, xor(g, g // {_u(1 << 33)}) AS g, s",
    ]
    for i, s in enumerate(steps, 1):
        out.append(f"{name}_{i} AS (SELECT * EXCLUDE (k, g, s), {s} FROM {name}_{i - 1})")
    out.append(f"{name} AS (SELECT * EXCLUDE (k, g, s), (k + g) % {_u(M64)} AS lo FROM {name}_{len(steps)})")
    return ",\n".join(out)


def bytes_of(t: str, first: int, n: int) -> str:
    """n characters of a text from ``first`` (counted from 1) as a little-endian integer."""
    return " + ".join(f"ascii(substr({t}, {first + i}, 1))::UHUGEINT * {_u(256**i)}" for i in range(n))


def _r32(x: str, r: int) -> str:
    return f"(((({x}) * {1 << r}::UBIGINT) & {M32}) | (({x}) >> {32 - r}))"


def murmur_x86(name: str, source: str, t: str, length: int, seed: int, keep: str) -> str:
    """CTEs that add lanes ``h1`` to ``h4`` of the x86 hash of a text of 13 to 15 bytes."""
    c, rot = (0x239B961B, 0xAB0E9789, 0x38B34AE5, 0xA1E38B93), (15, 16, 17, 18)
    lanes = [" + ".join(f"ascii(substr({t}, {4 * i + b + 1}, 1))::UBIGINT * {256**b}" for b in range(min(4, length - 4 * i))) for i in range(4)]
    names = ("h1", "h2", "h3", "h4")
    out = [f"{name}_0 AS (SELECT {keep}, " + ", ".join(f"((({x})::UBIGINT * {c[i]}::UBIGINT) & {M32}) AS h{i + 1}" for i, x in enumerate(lanes)) + f" FROM {source})"]
    total = f"((h1 + h2 + h3 + h4) & {M32})"
    add = ", ".join([f"{total} AS h1", *(f"(({h} + {total}) & {M32}) AS {h}" for h in names[1:])])
    each = lambda f: ", ".join(f"{f(h)} AS {h}" for h in names)
    steps = [
        ", ".join(f"xor(xor({seed}::UBIGINT, (({_r32(h, rot[i])} * {c[(i + 1) % 4]}::UBIGINT) & {M32})), {length}::UBIGINT) AS {h}" for i, h in enumerate(names)),
        add,
        each(lambda h: f"((xor({h}, {h} >> 16) * {0x85EBCA6B}::UBIGINT) & {M32})"),
        each(lambda h: f"((xor({h}, {h} >> 13) * {0xC2B2AE35}::UBIGINT) & {M32})"),
        each(lambda h: f"xor({h}, {h} >> 16)"),
        add,
    ]
    for i, s in enumerate(steps, 1):
        out.append(f"{name}_{i} AS (SELECT * EXCLUDE (h1, h2, h3, h4), {s} FROM {name}_{i - 1})")
    out.append(f"{name} AS (SELECT * FROM {name}_{len(steps)})")
    return ",\n".join(out)


#: A key of four bytes, the highest first, as the little-endian integer that is hashed.
SWAPPED = "((key >> 24) & 255) + ((key >> 16) & 255) * 256 + ((key >> 8) & 255) * 65536 + (key & 255) * 16777216"


def cells(name: str, tokens: str, k: int, r: int, chunk: int, sign: str = "1", by: str = "") -> str:
    """CTEs of the cells of a table over ``tokens`` (by, token), for keys of four bytes."""
    key = f"({code('token', k)} * {4 ** (16 - k)})::BIGINT"
    head = f"{by}, " if by else ""
    return ",\n".join([
        f"{name}_k AS (SELECT {head}{key} AS key, {sign} AS sign FROM {tokens})",
        f"{name}_r AS (SELECT *, unnest(range(0, {r})) AS row FROM {name}_k)",
        murmur_x64(f"{name}_h", f"{name}_r", SWAPPED, None, 4, f"{SEED} + row", "*"),
        f"{name} AS (SELECT {head}row::INT AS row, (lo % {chunk})::BIGINT AS col, sum(sign)::BIGINT AS counter, bit_xor(key) AS key FROM {name}_h GROUP BY ALL HAVING sum(sign) <> 0 OR bit_xor(key) <> 0)",
    ])
