"""Molecules from text as tables of atoms and bonds: restraint files (CIF loops) and SMILES.

CIF is taken apart by DataFrame functions alone; SMILES, whose branches and rings need a stack, by a table
function that each row of text meets by a lateral join. ``graphs.packed`` takes the tables of either.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Orders of the bond types of restraint files; a delocalised bond counts as single. 4 is an aromatic bond, as in mol files.
ORDERS = {"single": 1, "double": 2, "triple": 3, "aromatic": 4, "deloc": 1}
#: Blocks that hold a ligand, the first one found counts.
BLOCKS = ("comp_LIG", "comp_XXX")

# a text field, a quoted value (its quote ends it before a blank only), a comment, a plain value
_TOKEN = r"""(?m)^;[\s\S]*?\n;|'(?:[^'\n]|'(?=\S))*'|"(?:[^"\n]|"(?=\S))*"|#[^\n]*|\S+"""


def _value(token: Column) -> Column:
    """A token without its quotes; null for the signs of a missing value."""
    quoted = ((token.startswith("'") & token.endswith("'")) | (token.startswith('"') & token.endswith('"'))) & (F.length(token) > 1)
    field = token.startswith(";")
    inner = F.when(quoted, F.substr(token, F.lit(2), F.length(token) - 2)).when(field, F.regexp_replace(token, r"^;|\n;$", ""))
    return F.when(token.isin("?", "."), None).otherwise(F.coalesce(inner, token))


def _once(made: Column, use) -> Column:
    """``use`` of a value that is made once, as the element of an array; a column's expression would be made anew wherever a lambda looks at it."""
    return F.get(F.transform(F.array(made), use), F.lit(0))


def _first(tokens: Column, test) -> Column:
    """The number of tokens before the first that passes ``test``."""
    at = F.array_position(F.transform(tokens, test), True)
    return F.coalesce((F.when(at > 0, at) - 1).cast("int"), F.size(tokens))


def _blocks(text: str, blocks: Sequence[str] | None = None) -> Column:
    """A text's blocks, or those of the names ``blocks``, each from its name on."""
    found = F.slice(F.split(F.concat(F.lit("\n"), F.col(text)), r"(?i)\ndata_"), 2, 1_000_000)
    return found if blocks is None else F.filter(found, lambda b: _name(b).isin(*blocks))


def _name(block: Column) -> Column:
    return F.regexp_extract(block, r"^\S*", 0)


def _loops(block: Column) -> Column:
    """An array of a block's loops that have names and whole rows: loop (its number), k (names), n (rows), v (values) and l (names in lower case)."""
    tokens = F.filter(F.regexp_extract_all(F.regexp_replace(block, r"^\S*", ""), F.lit(_TOKEN), F.lit(0)), lambda t: ~t.startswith("#"))

    def cut(t: Column) -> Column:
        starts = F.filter(F.transform(t, lambda x, i: F.when(F.lower(x) == "loop_", i)), lambda i: i.isNotNull())
        until = lambda s, k: F.coalesce(F.get(s, k + 1), F.size(t))
        return _once(starts, lambda s: F.transform(s, lambda i, k: F.slice(t, i + 2, until(s, k) - i - 1)))

    def parted(u: Column, loop: Column) -> Column:
        k = _first(u, lambda x: ~x.startswith("_"))
        return _once(k, lambda k: F.struct(loop.alias("loop"), k.alias("k"), F.slice(u, k + 1, F.size(u)).alias("v"), F.transform(F.slice(u, F.lit(1), k), F.lower).alias("l")))

    def counted(x: Column) -> Column:
        n = F.when(x["k"] > 0, F.floor(_first(x["v"], lambda t: t.startswith("_")) / x["k"]).cast("int")).otherwise(0)
        return F.struct(x["loop"].alias("loop"), x["k"].alias("k"), n.alias("n"), x["v"].alias("v"), x["l"].alias("l"))

    return F.filter(F.transform(F.transform(_once(tokens, cut), parted), counted), lambda x: x["n"] > 0)


def loop_rows(files: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """(key, block, loop, row, fields): each row of each CIF loop, its values by their lower-case names.

    ``loop`` counts a block's loops and ``row`` a loop's rows, from 0. A missing value (``?`` or ``.``) is null; a last row
    that is not whole is left out, as is a loop without names or values. Null and empty texts have no rows. A
    line of a text field must not begin with ``data_``.
    """
    blocks = files.select(*key, F.explode(F.transform(_blocks(text), lambda b: F.struct(_name(b).alias("block"), _loops(b).alias("loops")))).alias("_b"))
    loops = blocks.select(*key, "_b.block", F.explode("_b.loops").alias("_x"))
    rows = loops.select(*key, "block", "_x", F.explode(F.sequence(F.lit(0), F.col("_x.n") - 1)).alias("row"))
    values = F.transform(F.slice("_x.v", F.col("row") * F.col("_x.k") + 1, F.col("_x.k")), _value)
    return rows.select(*key, "block", "_x.loop", "row", F.map_from_arrays("_x.l", values).alias("fields"))


def restraint_graphs(files: DataFrame, key: Sequence[str], text: str = "text", blocks: Sequence[str] = BLOCKS) -> tuple[DataFrame, DataFrame]:
    """Atoms (key, place, atom, element, charge) and bonds (key, a, b, order) of restraint files, a file a row of distinct ``key``.

    Of a file's blocks the first of ``blocks`` that has atoms is read. A charge is the formal one, else the partial one, rounded half
    to even, else 0. A bond that is marked aromatic is so whatever its type; an unknown type has order null. A
    sulphur with exactly three oxygens, all by single bonds, has its first two uncharged ones, by place, bonded twice, if
    there are two. Files without such a block have no rows.
    """
    read = restraint_rows(files, key, text, blocks)
    atoms = read.select(*key, F.explode_outer("_atoms").alias("_a")).where("_a is not null")
    bonds = read.select(*key, F.explode_outer("_bonds").alias("_b")).where("_b is not null")
    return atoms.select(*key, "_a.*"), bonds.select(*key, "_b.*")


def restraint_rows(files: DataFrame, key: Sequence[str], text: str = "text", blocks: Sequence[str] = BLOCKS) -> DataFrame:
    """(key, _atoms, _bonds): the atoms and bonds of ``restraint_graphs`` as arrays, a row a file; null or empty if it has none.

    A file is read within its row, so that nothing is shuffled.
    """
    known = F.create_map(*[F.lit(x) for p in ORDERS.items() for x in p])

    def fields(x: Column, kind: str, names: Sequence[str], made, whole) -> Column:
        """The rows of a loop that has the first of ``names``; null of another."""
        at = F.struct(*[F.array_position(x["l"], F.lit(f"_chem_comp_{kind}.{name}")).cast("int").alias(name) for name in names])

        def rows(at: Column, v: Column) -> Column:
            value = lambda r: lambda name: F.when(at[name] > 0, F.get(v, r * x["k"] + at[name] - 1))
            return F.filter(F.transform(F.sequence(F.lit(0), x["n"] - 1), lambda r: made(r, value(r))), whole)

        return _once(at, lambda at: F.when(at[names[0]] > 0, _once(F.transform(x["v"], _value), lambda v: rows(at, v))))

    def atom(r: Column, f) -> Column:
        charge = F.coalesce(f("charge").try_cast("double"), f("partial_charge").try_cast("double"), F.lit(0.0))
        return F.struct(r.alias("place"), f("atom_id").alias("atom"), F.initcap(f("type_symbol")).alias("element"), F.rint(charge).cast("int").alias("charge"))

    def bond(_: Column, f) -> Column:
        order = F.when(F.lower(f("aromatic")).isin("y", "yes"), 4).otherwise(F.try_element_at(known, F.lower(F.coalesce(f("type"), f("value_order"), F.lit("")))))
        return F.struct(f("atom_id_1").alias("a"), f("atom_id_2").alias("b"), order.alias("order"))

    def parts(x: Column, rank: Column) -> Column:
        atoms = fields(x, "atom", ("atom_id", "type_symbol", "charge", "partial_charge"), atom, lambda a: a["atom"].isNotNull())
        bonds = fields(x, "bond", ("atom_id_1", "atom_id_2", "type", "value_order", "aromatic"), bond, lambda b: b["a"].isNotNull() & b["b"].isNotNull())
        return F.struct(rank.alias("rank"), atoms.alias("atoms"), bonds.alias("bonds"))

    rank = lambda b: F.array_position(F.array(*[F.lit(x) for x in blocks]), _name(b))
    loops = F.flatten(F.transform(_blocks(text, blocks), lambda b: _once(rank(b), lambda k: F.transform(_loops(b), lambda x: parts(x, k)))))
    least = lambda g: F.array_min(F.transform(F.filter(g, lambda x: F.size(x["atoms"]) > 0), lambda x: x["rank"]))
    first = _once(loops, lambda g: _once(least(g), lambda low: F.filter(g, lambda x: x["rank"] == low)))
    part = lambda g, name: F.flatten(F.transform(F.filter(g, lambda x: x[name].isNotNull()), lambda x: x[name]))
    both = _once(first, lambda g: F.struct(part(g, "atoms").alias("atoms"), part(g, "bonds").alias("bonds")))
    sulphur = lambda x: F.exists(x["atoms"], lambda a: a["element"] == "S")
    both = _once(both, lambda x: F.struct(x["atoms"].alias("atoms"), F.when(sulphur(x), _sulphonates(x["atoms"], x["bonds"])).otherwise(x["bonds"]).alias("bonds")))
    return files.select(*key, both.alias("_both")).select(*key, F.col("_both.atoms").alias("_atoms"), F.col("_both.bonds").alias("_bonds"))


def _sulphonates(atoms: Column, bonds: Column) -> Column:
    """``bonds`` in which a sulphur with exactly three oxygens has its first two uncharged ones bonded twice."""

    def around(s: Column) -> Column:
        joined = lambda b, o: ((b["a"] == s) & (b["b"] == o)) | ((b["b"] == s) & (b["a"] == o))
        return F.filter(atoms, lambda x: (x["element"] == "O") & F.exists(bonds, lambda b: (b["order"] == 1) & joined(b, x["atom"])))

    def twice(s: Column, found: Column) -> Column:
        free = F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda x: x["charge"] != -1), lambda x: F.struct(x["place"].alias("place"), x["atom"].alias("o")))))
        three = (F.size(F.array_distinct(F.transform(found, lambda x: x["atom"]))) == 3) & (F.size(free) >= 2)
        return F.when(three, F.transform(F.slice(free, 1, 2), lambda x: F.struct(F.greatest(s, x["o"]).alias("hi"), F.least(s, x["o"]).alias("lo"))))

    sulphur = F.filter(atoms, lambda x: x["element"] == "S")
    pairs = F.flatten(F.filter(F.transform(sulphur, lambda x: twice(x["atom"], around(x["atom"]))), lambda p: p.isNotNull()))
    second = lambda ps, b: (b["order"] == 1) & F.exists(ps, lambda p: (p["hi"] == F.greatest(b["a"], b["b"])) & (p["lo"] == F.least(b["a"], b["b"])))
    ordered = lambda ps, b: F.struct(b["a"].alias("a"), b["b"].alias("b"), F.when(second(ps, b), 2).otherwise(b["order"]).alias("order"))
    return F.get(F.transform(F.array(pairs), lambda ps: F.transform(bonds, lambda b: ordered(ps, b))), F.lit(0))


_SYMBOL = re.compile(r"\[\d*([A-Z][a-z]?|[a-z][a-z]?|\*)(@{0,2}\w*?)(?:H(\d*))?([+-]+\d*)?(?::\d+)?\]|(Cl|Br|[BCNOPSFI*]|[bcnops])|([-=#$:/\\.])|(%\d\d|\d)|([()])")
_BOND = {"-": 1, "/": 1, "\\": 1, "=": 2, "#": 3, "$": 4, ":": 4}


def parse_smiles(text: str) -> Iterator[tuple]:
    """(part, a, b, element, charge, order): a row for each atom (a, its number from 0) and for each bond (a < b).

    What is not SMILES gives the one row ``('error', place, ...)``. Bonds between two aromatic atoms that are written without a
    sign are aromatic (4). Hydrogens that are not atoms of the text have no rows.
    """
    atoms, bonds, stack, rings = [], {}, [], {}
    last, sign, at = None, None, 0

    def bond(a: int, b: int, own: str | None) -> bool:
        plain = 4 if atoms[a][1] and atoms[b][1] else 1
        pair = (min(a, b), max(a, b))
        return a != b and bonds.setdefault(pair, _BOND[own] if own else plain) is not None

    while at < len(text):
        m = _SYMBOL.match(text, at)
        if not m:
            break
        inside, _, _, charge, plain, mark, ring, branch = m.groups()
        if inside or plain:
            name, n = inside or plain, 0
            if charge:
                digits = charge.strip("+-")
                n = (int(digits) if digits else len(charge)) * (1 if charge[0] == "+" else -1)
            atoms.append((name.capitalize(), name.islower(), n))
            if last is not None and sign != ".":
                bond(last, len(atoms) - 1, sign)
            last, sign = len(atoms) - 1, None
        elif mark:
            if last is None or sign:
                break
            sign = mark
        elif ring:
            if last is None or sign == ".":
                break
            n = ring.lstrip("%").lstrip("0") or "0"
            if n in rings:
                other, own = rings.pop(n)
                if (own and sign and _BOND[own] != _BOND[sign]) or (min(other, last), max(other, last)) in bonds or not bond(other, last, own or sign):
                    break
            else:
                rings[n] = (last, sign)
            sign = None
        elif branch == "(":
            if last is None or sign:
                break
            stack.append(last)
        else:
            if not stack or sign:
                break
            last = stack.pop()
        at = m.end()
    if at < len(text) or stack or rings or sign:
        yield ("error", at, None, None, None, None)
        return
    for i, (name, _, n) in enumerate(atoms):
        yield ("atom", i, None, name, n, None)
    for (a, b), order in sorted(bonds.items()):
        yield ("bond", a, b, None, None, order)


@udtf(returnType="part string, a int, b int, element string, charge int, order int")
class Smiles:
    """The rows of ``parse_smiles`` for one text; null and blank texts have none."""

    def eval(self, text: str):
        words = (text or "").split()
        if words:
            yield from parse_smiles(words[0])


def smiles_graphs(texts: DataFrame, key: Sequence[str], text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Atoms (key, atom, element, charge), bonds (key, a, b, order) and faults (key, place) of SMILES, a molecule a row.

    The first word of a text is read, as names may follow it. Texts that are not SMILES are in ``faults`` alone, with the place that was not understood.
    """
    parts = texts.select(*key, F.col(text).alias("_text")).lateralJoin(Smiles(F.col("_text").outer())).drop("_text")
    atoms = parts.where("part = 'atom'").select(*key, F.col("a").alias("atom"), "element", "charge")
    return atoms, parts.where("part = 'bond'").select(*key, "a", "b", "order"), parts.where("part = 'error'").select(*key, F.col("a").alias("place"))
