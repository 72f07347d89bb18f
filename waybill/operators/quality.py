"""Validation of incoming rows and integrity of stored ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waybill import fixed
from waybill.functions.expressions import phone_valid
from waybill.schemas import required_columns
from waybill.session import checkpointed

BROKEN = "broken_rules"
_REPORT = ["table_name", "rule", "violations"]


@dataclass(frozen=True)
class Rule:
    """A named condition; a row breaks it when the condition is false. NULL passes, as in SQL."""

    name: str
    condition: Column

    @property
    def broken(self) -> Column:
        return F.coalesce(~self.condition, F.lit(False))


# --- rule makers -------------------------------------------------------------------------------

def filled(column: str) -> Rule:
    """Present and not empty."""
    return Rule(f"{column}_empty", F.coalesce(F.length(column) >= 1, F.lit(False)))


def not_empty(column: str) -> Rule:
    """Not empty when present."""
    return Rule(f"{column}_empty", F.length(column) >= 1)


def at_most(column: str, length: int) -> Rule:
    return Rule(f"{column}_too_long", F.length(column) <= length)


def positive(column: str, required: bool = True) -> Rule:
    """Above zero and a number."""
    value = F.col(column)
    good = (value > 0) & ~F.isnan(value.cast("double"))
    return Rule(f"{column}_not_positive", F.coalesce(good, F.lit(not required)))


def fits(column: str, kind: str = "decimal(10,2)") -> Rule:
    """Small enough, once rounded, for the column it goes into; what is no number is another rule's."""
    value = F.col(column).cast("double")
    usual = value.isNull() | F.isnan(value) | (value <= 0)
    return Rule(f"{column}_too_large", usual | value.try_cast(kind).isNotNull())


def one_of(column: str, allowed: list[str], required: bool = False) -> Rule:
    return Rule(f"{column}_not_allowed",
                F.coalesce(F.col(column).isin(allowed), F.lit(not required)))


def phone(column: str) -> Rule:
    return Rule(f"{column}_not_a_phone", phone_valid(column))


# --- validators --------------------------------------------------------------------------------

def validate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add the names of the broken rules, found in one pass.

    They come out of a generator, as a filter on them would else be pushed below and compute all rules again.
    """
    marks = [F.when(rule.broken, F.lit(rule.name)) for rule in rules]
    return df.withColumn(BROKEN, F.explode(F.array(F.array_compact(F.array(*marks)))))


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejects)``; only rejects keep the broken rules."""
    broken = F.size(BROKEN) > 0
    return checked.where(~broken).drop(BROKEN), checked.where(broken)


def _known(df: DataFrame, rules: list[tuple[str, Rule]]) -> list[Rule]:
    return [rule for column, rule in rules if column in df.columns]


def _text_limits(df: DataFrame) -> list[Rule]:
    limits = [(c, at_most(c, n)) for c, n in fixed.PAYLOAD_LENGTHS.items()]
    phones = [(c, phone(c)) for c in ("sender_phone", "receiver_phone")]
    return _known(df, limits + phones)


def shipment_rules(df: DataFrame) -> list[Rule]:
    texts = ["sender_name", "sender_address", "receiver_name", "receiver_address", "package_details"]
    sides = [f"dimensions.{s}" for s in ("length", "width", "height")]
    return ([filled(c) for c in texts] + _text_limits(df)
            + [positive("weight"), positive("cost"), fits("weight"), fits("cost")]
            + [positive(s) for s in sides]
            + [one_of("service_type", fixed.DOCUMENT_SERVICES, required=True)])


def validate_shipments(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New shipment payloads, after defaults."""
    return split(validate(payloads, shipment_rules(payloads)))


def patch_rules(df: DataFrame) -> list[Rule]:
    texts = ["sender_name", "sender_address", "receiver_name", "receiver_address", "package_details"]
    rules = [(c, not_empty(c)) for c in texts]
    rules += [(c, rule) for c in ("weight", "cost") for rule in (positive(c, required=False), fits(c))]
    rules += [("service_type", one_of("service_type", fixed.DOCUMENT_SERVICES)),
              ("status", one_of("status", fixed.DOCUMENT_STATUSES))]
    if "dimensions" in df.columns:
        given = F.col("dimensions").isNotNull()
        rules += [("dimensions", Rule(f"dimensions.{s}_not_positive", ~given | positive(f"dimensions.{s}").condition))
                  for s in ("length", "width", "height")]
    return _known(df, rules) + _text_limits(df)


def validate_patches(patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patches: only the fields that hold a value are looked at."""
    return split(validate(patches, patch_rules(patches)))


def validate_hubs(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    rules = [filled(c) for c in ("name", "code", "address", "city", "state")]
    rules += [positive("capacity"), one_of("status", fixed.PAYLOAD_HUB_STATUSES, required=True)]
    return split(validate(payloads, rules))


def user_rules(roles: list[str]) -> list[Rule]:
    return [filled("full_name"), at_most("full_name", 255), filled("email"),
            one_of("role", roles, required=True)]


def validate_users(payloads: DataFrame,
                   roles: list[str] = fixed.ALLOWED["users", "role"]) -> tuple[DataFrame, DataFrame]:
    return split(validate(payloads, user_rules(roles)))


def validate_routes(routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split(validate(routes, check_rules("routes", routes)))


# --- declared constraints ----------------------------------------------------------------------

def check_rules(table: str, df: DataFrame | None = None) -> list[Rule]:
    """The CHECKs a table declares; with ``df`` only those whose columns it has."""
    rules = [(column, Rule(f"{column}_check", F.col(column).isin(values)))
             for (owner, column), values in fixed.ALLOWED.items() if owner == table]
    rules += [(name, Rule(f"{name}_check", F.expr(condition)))
              for (owner, name), condition in fixed.NUMERIC_CHECKS.items() if owner == table]
    if df is None:
        return [rule for _, rule in rules]
    needs = {"no_self_route": ["origin_hub_id", "destination_hub_id"]}
    return [rule for name, rule in rules if set(needs.get(name, [name])) <= set(df.columns)]


def not_null_rules(table: str, df: DataFrame) -> list[Rule]:
    return [Rule(f"{c}_not_null", F.col(c).isNotNull())
            for c in required_columns(table) if c in df.columns]


def count_broken(table: str, df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Violations per rule, all rules counted in one scan."""
    counts = [F.count_if(rule.broken).alias(f"r{i}") for i, rule in enumerate(rules)]
    pairs = [F.struct(F.lit(rule.name).alias("rule"), F.col(f"r{i}").alias("violations"))
             for i, rule in enumerate(rules)]
    return (df.agg(*counts).select(F.explode(F.array(*pairs)).alias("p"))
            .select(F.lit(table).alias("table_name"), "p.rule", "p.violations"))


def check_constraints(tables: Mapping[str, DataFrame]) -> DataFrame:
    return _union([count_broken(t, df, rules) for t, df in tables.items()
                   if (rules := check_rules(t, df))])


def not_null_check(tables: Mapping[str, DataFrame]) -> DataFrame:
    return _union([count_broken(t, df, rules) for t, df in tables.items()
                   if (rules := not_null_rules(t, df))])


def duplicate_keys(df: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """Keys more than one row has. NULLs never collide; ``where`` makes the key a partial one."""
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    rows = df.where(known if where is None else known & where)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")


# --- what the rows of a table offer to the checks, from one scan ---------------------------------

#: Repeated hashes up to which they are broadcast, at 12 bytes each; beyond, Spark joins as it sees fit.
MOST_BROADCAST = 1_000_000
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class _Offer:
    """What a row offers to the check numbered ``ref``: one or two numbers, or a text; nothing if ``condition`` is false.

    A key that is counted exactly offers the number of its block of 64 neighbours, and its place there as one of 64 ``bits``.
    """

    ref: int
    condition: Column
    number: Column
    more: Column | None = None
    text: Column | None = None
    bits: Column | None = None

    def fields(self, names: list[str]) -> list[Column]:
        given = {"ref": F.when(self.condition, F.lit(self.ref)), "number": self.number, "more": self.more, "text": self.text, "bits": self.bits}
        absent = {"more": F.lit(0).cast("bigint"), "text": F.lit(None).cast("string"), "bits": F.lit(None).cast("bigint")}
        return [absent[n] if given[n] is None else given[n] for n in names]


def _known_all(columns: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])


def _number(df: DataFrame, column: str) -> Column | None:
    """The column as a number that tells all its values apart, if it has one."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("bigint")
    return F.col(column).cast("bigint") if isinstance(kind, _WHOLE) else None


def _exact(df: DataFrame, key: list[str]) -> bool:
    """Whether one or two numbers stand for the key, so that none of its values need be looked at again."""
    return len(key) <= 2 and all(_number(df, k) is not None for k in key)


def _exact_and_hashed(tables: Mapping[str, DataFrame], declared: list[tuple[str, list[str]]],
                      first: int = 0) -> tuple[list[int], list[int]]:
    exact = [ref for ref, (table, key) in enumerate(declared, first) if _exact(tables[table], key)]
    return exact, [ref for ref in range(first, first + len(declared)) if ref not in exact]


def _counted(tables: Mapping[str, DataFrame], offers: Mapping[str, list[_Offer]], exact: Sequence[int] = (),
             hashed: Sequence[int] = ()) -> DataFrame:
    """Rows (ref, number, more, n; text where some offer has one): each table is scanned once and its rows' offers meet in one
    aggregation, combined before the shuffle. ``exact`` keys are left with one row each, their surplus; hashes of ``hashed`` keys
    that occur once end there. Counted as rows and not as observed metrics, which a stage that runs again would count twice."""
    with_text = any(o.text is not None for own in offers.values() for o in own)
    names = ["ref", "number", "more"] + ["text"] * with_text
    offered = names + ["bits"] * bool(exact)
    found = []
    for table, own in offers.items():
        if own:
            found.append(_unpivoted(tables[table], [offer.fields(offered) for offer in own], offered))
    if not found:
        kinds = ", ".join(f"{c} {'int' if c == 'ref' else 'string' if c == 'text' else 'bigint'}" for c in [*names, "n"])
        return next(iter(tables.values())).sparkSession.createDataFrame([], kinds)
    totals = [F.count(F.lit(1)).alias("n")] + [F.bit_or("bits").alias("bits")] * bool(exact)
    counts = _union(found).groupBy(*names).agg(*totals)
    if hashed:
        counts = counts.where(~F.col("ref").isin(hashed) | (F.col("n") > 1))
    if exact:
        # Their surplus is added up before the rows are written: one row per key is left.
        is_exact = F.col("ref").isin(exact)
        parts = [F.when(~is_exact, F.col(c)).alias(c) for c in names[1:]]
        surplus = F.col("n") - F.bit_count("bits")
        counts = (counts.select("ref", *parts, F.when(is_exact, surplus).otherwise(F.col("n")).alias("n"))
                  .groupBy(*names).agg(F.sum("n").alias("n")))
    return counts


def _unpivoted(df: DataFrame, offers: list[list[Column]], names: list[str]) -> DataFrame:
    """One row per offer made, as an unpivot of several columns at once: rows are multiplied without an array of them each."""
    wide = df.select(*[field.alias(f"{name}{i}") for i, fields in enumerate(offers) for name, field in zip(names, fields)])
    each = ", ".join(f"({', '.join(f'{name}{i}' for name in names)}) as `{i}`" for i in range(len(offers)))
    return df.sparkSession.sql(
        f"select {', '.join(names)} from {{wide}} unpivot (({', '.join(names)}) for offer in ({each})) where ref is not null", wide=wide)


def _declared_keys(tables: Mapping[str, DataFrame], keys: Mapping[str, list[list[str]]]) -> list[tuple[str, list[str]]]:
    return [(table, key) for table, df in tables.items() for key in keys.get(table, []) if set(key) <= set(df.columns)]


def _key_offers(df: DataFrame, table: str, declared: list[tuple[str, list[str]]], first: int = 0) -> list[_Offer]:
    """Numbers stand for themselves, in blocks of 64 so that neighbours share a row; all other keys offer a hash."""
    offers = []
    for ref, (owner, key) in enumerate(declared, first):
        if owner == table:
            if _exact(df, key):
                number, *more = [_number(df, k) for k in key]
                place = F.call_function("shiftleft", F.lit(1).cast("bigint"), number.bitwiseAND(F.lit(63)).cast("int"))
                offers.append(_Offer(ref, _known_all(key), F.shiftright(number, 6), *more, bits=place))
            else:
                offers.append(_Offer(ref, _known_all(key), F.xxhash64(*key)))
    return offers


def _by_number(tables: Mapping[str, DataFrame], reference: tuple[str, str, str, bool]) -> bool:
    child, column, parent, _ = reference
    return all(isinstance(tables[t].schema[c].dataType, _WHOLE) for t, c in ((child, column), (parent, "id")))


def _reference_offers(tables: Mapping[str, DataFrame], table: str, references: list[tuple[str, str, str, bool]],
                      first: int = 0) -> list[_Offer]:
    offers = []
    for ref, reference in enumerate(references, first):
        if reference[0] == table:
            value = F.col(reference[1])
            offers.append(_Offer(ref, value.isNotNull(), value.cast("bigint")) if _by_number(tables, reference) else
                          _Offer(ref, value.isNotNull(), F.lit(0).cast("bigint"), text=value.cast("string")))
    return offers


def _surplus(counted: DataFrame, tables: Mapping[str, DataFrame], declared: list[tuple[str, list[str]]], first: int = 0) -> DataFrame:
    """Surplus rows (ref, n) of keys. Keys made of numbers are counted already. Of the others, only values whose hash occurs more
    than once are looked at, and compared by value; tables without such hashes are not read again."""
    exact, hashed = _exact_and_hashed(tables, declared, first)
    found = [counted.where(F.col("ref").isin(exact)).select("ref", "n")]
    repeated = counted.where(F.col("ref").isin(hashed)).select("ref", F.col("number").alias("_hash"))
    sizes = {r["ref"]: r["count"] for r in repeated.groupBy("ref").count().collect()} if hashed else {}
    for ref in sizes:
        table, key = declared[ref - first]
        own = repeated.where(F.col("ref") == ref).select("_hash")
        if sum(sizes.values()) <= MOST_BROADCAST:
            own = F.broadcast(own)
        rows = tables[table].select(*key).where(_known_all(key)).withColumn("_hash", F.xxhash64(*key))
        found.append(rows.join(own, "_hash", "left_semi").groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("n"))
                     .agg(F.sum("n").alias("n")).select(F.lit(ref).alias("ref"), "n"))
    return _union(found)


def _orphans(counted: DataFrame, tables: Mapping[str, DataFrame], references: list[tuple[str, str, str, bool]],
             first: int = 0) -> DataFrame:
    """Rows (ref, n) of references without a parent: the distinct values of all references to one parent meet its ids."""
    groups: dict[tuple[str, bool], list[int]] = {}
    for ref, reference in enumerate(references, first):
        groups.setdefault((reference[2], _by_number(tables, reference)), []).append(ref)
    found = []
    for (parent, by_number), own in groups.items():
        name, kind = ("number", "bigint") if by_number else ("text", "string")
        ids = tables[parent].select(F.col("id").cast(kind).alias(name))
        found.append(counted.where(F.col("ref").isin(own)).select("ref", name, "n").join(ids, name, "left_anti").select("ref", "n"))
    if not found:
        return counted.select("ref", "n").where("false")
    return _union(found).groupBy("ref").agg(F.sum("n").alias("n"))


def unique_violations(tables: Mapping[str, DataFrame],
                      keys: Mapping[str, list[list[str]]] = fixed.UNIQUE_KEYS) -> DataFrame:
    """Surplus rows per declared key: those beyond the first of each key.

    Keys of one or two whole numbers or dates are counted as they are, in one pass, 64 neighbours to a row. Others are counted by 64-bit hashes of their
    typed values; only those whose hash repeats are compared by value.
    """
    declared = _declared_keys(tables, keys)
    exact, hashed = _exact_and_hashed(tables, declared)
    counted = _counted(tables, {t: _key_offers(df, t, declared) for t, df in tables.items()}, exact, hashed)
    if hashed:
        counted = checkpointed(counted)
    return _per_rule(_surplus(counted, tables, declared), [(table, "_".join(key) + "_unique") for table, key in declared])


def _per_rule(counts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """One row per rule, also for those without violations; ``ref`` is the place in ``rules``."""
    lines = F.array(*[F.struct(F.lit(i).alias("ref"), F.lit(table).alias("table_name"), F.lit(rule).alias("rule"))
                      for i, (table, rule) in enumerate(rules)])
    return (counts.sparkSession.range(1).select(F.inline(lines)).join(counts, "ref", "left")
            .select("table_name", "rule", F.coalesce("n", F.lit(0)).cast("bigint").alias("violations")))


# --- references --------------------------------------------------------------------------------

def _usable(tables: Mapping[str, DataFrame]) -> list[tuple[str, str, str, bool]]:
    return [fk for fk in fixed.FOREIGN_KEYS
            if fk[0] in tables and fk[2] in tables and fk[1] in tables[fk[0]].columns]


def fk_orphans(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per reference whose parent is missing, for every declared reference at hand.

    Each child table is scanned once; its references are reduced to distinct values with counts, so a value many rows share
    costs one row. Each parent is joined by itself, so a small one is broadcast by Spark whatever the size of the others.
    """
    references = _usable(tables)
    counted = checkpointed(_counted(tables, {t: _reference_offers(tables, t, references) for t in tables}))
    return _per_rule(_orphans(counted, tables, references),
                     [(child, f"{column}_reference") for child, column, _, _ in references])


def orphan_rows(child: DataFrame, column: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """The child rows whose reference has no parent."""
    known = parent.select(F.col(parent_key).alias(column)).distinct()
    return child.where(F.col(column).isNotNull()).join(known, column, "left_anti")


def cascade_delete(tables: Mapping[str, DataFrame], table: str,
                   keys: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Delete rows of ``table`` by ``id`` with everything that is deleted along with them.

    A key is refused when a row that would stay points at it, or at a row deleted along with it.
    Returns the remaining tables that changed, and the refused keys with their reasons
    (``id, reason``).
    """
    wanted = keys.select("id").distinct()
    refusals = _refusals(tables, table, wanted)
    granted = wanted.join(refusals.select("id").distinct(), "id", "left_anti")
    return _without(tables, table, granted), refusals


def _refusals(tables: Mapping[str, DataFrame], table: str, ids: DataFrame) -> DataFrame:
    """``id, reason`` of the ids that may not go. References form no cycle among deleted rows."""
    found = [ids.where("false").select("id", F.lit("").alias("reason"))]
    for child, column, parent, cascades in _usable(tables):
        if parent != table:
            continue
        pointing = tables[child].join(ids, F.col(column) == ids["id"]) if not cascades else None
        if not cascades:
            found.append(pointing.select(ids["id"], F.lit(f"{child}.{column}").alias("reason")))
        elif "id" in tables[child].columns and any(fk[2] == child for fk in _usable(tables)):
            rows = tables[child].select(F.col("id").alias("child_id"), F.col(column).alias("id"))
            going = rows.join(ids, "id")
            below = _refusals(tables, child, going.select(F.col("child_id").alias("id")).distinct())
            found.append(going.join(below.withColumnRenamed("id", "child_id"), "child_id")
                         .select("id", "reason"))
    return _union(found).distinct()


def _without(tables: Mapping[str, DataFrame], table: str, ids: DataFrame) -> dict[str, DataFrame]:
    left = {table: tables[table].join(ids, "id", "left_anti")}
    for child, column, parent, cascades in _usable(tables):
        if parent != table or not cascades:
            continue
        gone = ids.select(F.col("id").alias(column))
        rows = left.get(child, tables[child])
        if any(fk[2] == child and fk[3] for fk in _usable(tables)):
            lost = tables[child].join(gone, column).select("id").distinct()
            below = _without({**tables, **left}, child, lost)
            left |= {t: df for t, df in below.items() if t != child}
        left[child] = rows.join(gone, column, "left_anti").select(*tables[child].columns)
    return left


def integrity_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All declared rules of the given tables: ``table_name, rule, violations``.

    One scan of each table offers broken rules, hashes of keys and references together.
    """
    rules = [(t, rule) for t, df in tables.items() for rule in check_rules(t, df) + not_null_rules(t, df)]
    declared, references = _declared_keys(tables, fixed.UNIQUE_KEYS), _usable(tables)
    keys_at, references_at = len(rules), len(rules) + len(declared)
    offers = {t: [_Offer(i, rule.broken, F.lit(0).cast("bigint")) for i, (owner, rule) in enumerate(rules) if owner == t]
              + _key_offers(df, t, declared, keys_at) + _reference_offers(tables, t, references, references_at)
              for t, df in tables.items()}
    counted = checkpointed(_counted(tables, offers, *_exact_and_hashed(tables, declared, keys_at)))
    broken = counted.where(F.col("ref") < keys_at).select("ref", "n")
    counts = _union([broken, _surplus(counted, tables, declared, keys_at), _orphans(counted, tables, references, references_at)])
    return _per_rule(counts, [(t, rule.name) for t, rule in rules] + [(t, "_".join(key) + "_unique") for t, key in declared]
                     + [(child, f"{column}_reference") for child, column, _, _ in references])


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
