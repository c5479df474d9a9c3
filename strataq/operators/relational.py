"""Search, enumeration and cross-reference operators, generic over column names.

The reference's id tables (classes, methods, fields, call sites) and any other
tables with an entity, a text or an edge bind to the same functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataq.functions.match import match


def search(df: DataFrame, text: str, query: str, match_type: str = "contains", ignore_case: bool = False) -> DataFrame:
    return df.where(match(text, query, match_type, ignore_case))


def using_all_strings(df: DataFrame, entity: str, text: str, queries: list[str], match_type: str = "contains", ignore_case: bool = False) -> DataFrame:
    """Entities for which every query is matched by some of their strings; an empty query list matches all."""
    hits = [F.max(match(text, q, match_type, ignore_case)).alias(f"_q{i}") for i, q in enumerate(queries)]
    if not queries:
        return df.select(entity).distinct()
    got = df.groupBy(entity).agg(*hits)
    keep: Column = F.lit(True)
    for i in range(len(queries)):
        keep = keep & F.col(f"_q{i}")
    return got.where(keep).select(entity)


def batch_search(df: DataFrame, entity: str, text: str, queries: dict[str, list[str]], match_type: str = "contains", keep_empty: bool = True) -> DataFrame:
    """(label, entity), each once: every query of the label is matched by some string of the entity. One pass for all labels.

    With keep_empty, a label without a hit has one row with a null entity. No label is matched by an empty query list at this layer.
    """
    flags = {(k, i): f"_m{j}_{i}" for j, (k, qs) in enumerate(queries.items()) for i in range(len(qs))}
    aggs = [F.max(match(text, queries[k][i], match_type)).alias(c) for (k, i), c in flags.items()]
    labels = df.sparkSession.createDataFrame([(k,) for k in queries], "label string")
    if not aggs:
        return labels.select("label", F.lit(None).cast(df.schema[entity].dataType).alias(entity)) if keep_empty else labels.select("label", F.lit(None).alias(entity)).limit(0)
    per = df.groupBy(entity).agg(*aggs)
    hits = []
    for k, qs in queries.items():
        if qs:
            every = F.lit(True)
            for i in range(len(qs)):
                every = every & F.col(flags[k, i])
            hits.append(F.when(every, F.lit(k)))
    got = per.select(F.explode(F.array_compact(F.array(*hits))).alias("label"), entity)
    return labels.join(got, "label", "left") if keep_empty else got


def declaring_all_strings(df: DataFrame, entity: str, text: str, queries: list[str], match_type: str = "contains", ignore_case: bool = False) -> DataFrame:
    """As using_all_strings, over declared strings; an empty query list finds nothing here."""
    got = using_all_strings(df, entity, text, queries, match_type, ignore_case)
    return got if queries else got.limit(0)


def search_members(members: DataFrame, name: str, owner: str, declared: DataFrame, query: str, match_type: str = "contains", declaring: str = "", ignore_case: bool = False) -> DataFrame:
    """Members by name: unscoped, all whose owner is declared; scoped, those of one owner (compared with equals)."""
    got = members.where(match(name, query, match_type, ignore_case))
    if declaring:
        got = got.where(F.col(owner) == declaring)
    return got.join(declared.select(owner).distinct(), owner, "left_semi")


def with_any(df: DataFrame, items: str, query: str, match_type: str = "equals") -> DataFrame:
    """Rows with some element of an array that matches (direct interfaces)."""
    return df.where(F.exists(items, lambda x: match(x, query, match_type)))


def annotated(df: DataFrame, annotation: str, query: str) -> DataFrame:
    """Rows whose annotation class contains L<query>; whatever match type is asked for."""
    base = query[1:-1] if query.startswith("L") and query.endswith(";") else query
    return df.where(F.contains(F.col(annotation), F.lit("L" + base.replace(".", "/") + ";")))


def filter_refs(df: DataFrame, equal: dict[str, str] | None = None, prefix: dict[str, str | tuple[str, ...]] | None = None, contains: dict[str, str] | None = None) -> DataFrame:
    """AND of the given criteria by column; empty ones are ignored, a prefix may be several."""
    for c, v in (equal or {}).items():
        df = df.where(F.col(c) == v) if v else df
    for c, v in (prefix or {}).items():
        if v:
            ok = F.lit(False)
            for one in (v,) if isinstance(v, str) else v:
                ok = ok | F.col(c).startswith(one)
            df = df.where(ok)
    for c, v in (contains or {}).items():
        df = df.where(F.contains(F.col(c), F.lit(v))) if v else df
    return df


def using_all_doubles(df: DataFrame, entity: str, number: str, values: list[float]) -> DataFrame:
    """Entities that use every one of the values, compared exactly."""
    vals = sorted(set(values))
    return df.where(F.col(number).isin(vals)).groupBy(entity).agg(F.countDistinct(number).alias("_n")).where(F.col("_n") == len(vals)).select(entity)


def using_all_numbers(df: DataFrame, entity: str, number: str, values: list[int]) -> DataFrame:
    """Entities that use every one of the values (32-bit literals)."""
    vals = sorted({(v + (1 << 31)) % (1 << 32) - (1 << 31) for v in values})
    return df.where(F.col(number).isin(vals)).groupBy(entity).agg(F.countDistinct(number).alias("_n")).where(F.col("_n") == len(vals)).select(entity)


def external_refs(refs: DataFrame, declared: DataFrame, anti: str, group: list[str], where: str, out: str = "places") -> DataFrame:
    """References whose `anti` column nothing declares, grouped by `group`, with the sorted set of places that hold them."""
    kept = refs.join(declared.select(anti).distinct(), anti, "left_anti")
    return kept.groupBy(*group).agg(F.sort_array(F.collect_set(where)).alias(out))


def declared_refs(refs: DataFrame, declared: DataFrame, key: str) -> DataFrame:
    return refs.join(declared.select(key), key, "left_semi")


def sites_to(edges: DataFrame, targets: DataFrame, target: str) -> DataFrame:
    """One row per edge into a target; edges are not made distinct."""
    return edges.join(targets, target)


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """For each key the row with the least order, by a partial aggregation instead of a sort."""
    rest = [c for c in df.columns if c not in (key, order)]
    got = df.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("_w"))
    return got.select(key, "_w.*")


def first_occurrence(df: DataFrame, value: str, rank: list[str]) -> DataFrame:
    """Distinct values with the least rank at which each occurs."""
    got = df.groupBy(value).agg(F.min(F.struct(*rank)).alias("_r"))
    return got.select(value, *[F.col("_r")[c].alias(f"first_{c}") for c in rank])


def paginate(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """offset is clamped at 0, limit at 1; order must be total."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, limit))


def top(df: DataFrame, key: str, n: int, count: str = "n") -> DataFrame:
    got = df.groupBy(key).agg(F.count(F.lit(1)).alias(count))
    return got.orderBy(F.desc(count), key).limit(max(1, n))


def overload_join(dim: DataFrame, refs: DataFrame, on: list[str]) -> DataFrame:
    """Join signatures to references with the overload rule.

    One full signature of the name: any reference matches. Else the arity must agree, and where that arity is
    shared by several signatures, the parameter types too. dim has arity and types, refs also `sig` (the full signature).
    refs are read once: distinct signatures by arity, then their sum by name over a window of these few rows.
    """
    per = refs.groupBy(*on, "arity").agg(F.count_distinct("sig").alias("same_arity"), F.collect_set(F.struct("types", "sig")).alias("_s"))
    per = per.withColumn("total", F.sum("same_arity").over(Window.partitionBy(*on)))
    known = per.select(*on, "arity", "same_arity", "total", F.explode("_s").alias("_s")).select(*on, "arity", "same_arity", "total", "_s.types", "_s.sig")
    d = dim.withColumnsRenamed({"arity": "d_arity", "types": "d_types"})
    ok = (F.col("total") <= 1) | ((F.col("arity") == F.col("d_arity")) & ((F.col("same_arity") <= 1) | (F.col("types") == F.col("d_types"))))
    return d.join(known, on).where(ok)


def external_method_index(refs: DataFrame, cls: str, name: str) -> DataFrame:
    """refs with `index_name`: every <init> also under the simple name of its (dotted, $ as .) class."""
    dotted = F.translate(cls, "/$", "..")
    simple = F.substring_index(dotted, ".", -1)
    names = F.when(F.col(name) == "<init>", F.array(F.col(name), simple)).otherwise(F.array(F.col(name)))
    return refs.withColumn("index_class", dotted).withColumn("index_name", F.explode(names))


def permission_callers(apis: DataFrame, sites: DataFrame, key: str, caller: str, drop: Column | None = None, levels: list[str] | None = None) -> DataFrame:
    """permission, apis (sorted array of (api, sorted callers)); entries without a kept caller go. apis: permission, level, api, key."""
    if levels:
        apis = apis.where(F.col("level").isin(levels))
    kept = sites.where(~drop) if drop is not None else sites
    per = kept.join(apis, key).groupBy("permission", "api").agg(F.sort_array(F.collect_set(caller)).alias("callers"))
    return per.groupBy("permission").agg(F.sort_array(F.collect_list(F.struct("api", "callers"))).alias("apis"))


def type_references(fields: DataFrame, methods: DataFrame, kind: str) -> DataFrame:
    """(role, member): fields of the type, methods that return it, methods that take it (once each, however often).

    fields: member, type; methods: member, returns, params (array).
    """
    one = lambda df, role: df.select(F.lit(role).alias("role"), "member")
    t = F.lit(kind)
    return one(fields.where(F.col("type") == t), "field").unionByName(one(methods.where(F.col("returns") == t), "return")).unionByName(one(methods.where(F.array_contains("params", t)), "param"))


def class_summary(declared: DataFrame, members: DataFrame, seen: DataFrame, key: str, order: str) -> DataFrame:
    """key, dex_id, access_flags, members for each class, declared or only seen.

    Declared: the row of the least `order`, with the members of that place. External: members seen in any place, distinct and
    sorted, dex_id -1 and flags NULL (unknown, which is not 0). members: key, order, member; seen: key, member.
    """
    win = first_wins(declared.select(key, order, "access_flags"), key, order)
    own = members.groupBy(key, order).agg(F.sort_array(F.collect_set("member")).alias("members"))
    none = F.array().cast("array<string>")
    inner = win.join(own, [key, order], "left").select(key, F.col(order).alias("dex_id"), "access_flags", F.coalesce("members", none).alias("members"))
    outer = seen.join(win.select(key), key, "left_anti").groupBy(key).agg(F.sort_array(F.collect_set("member")).alias("members"))
    return inner.unionByName(outer.select(key, F.lit(-1).cast(win.schema[order].dataType).alias("dex_id"), F.lit(None).cast(win.schema["access_flags"].dataType).alias("access_flags"), "members"))


def assignable(edges: DataFrame, sub: str, sup: str, most_depth: int = 1000) -> DataFrame:
    """(sub, sup): all direct and indirect supertypes, by a recursive query; cycles end, as a pair is met once."""
    spark = edges.sparkSession
    edges.select(F.col(sub).alias("a"), F.col(sup).alias("b")).distinct().createOrReplaceTempView("_edges")
    return spark.sql(
        f"with recursive up(a, b, path) max recursion level {most_depth} as (select a, b, array(a, b) from _edges union all "
        "select up.a, e.b, array_append(up.path, e.b) from up join _edges e on e.a = up.b where not array_contains(up.path, e.b)) "
        "select distinct a as sub, b as sup from up where a <> b"
    )


def page(df: DataFrame, order: list, offset: int, limit: int) -> tuple[DataFrame, dict]:
    """A page and its facts: total, offset (clamped to 0..total), limit (at least 1), next_offset (None at the end)."""
    total = df.count()
    offset, limit = min(max(0, offset), total), max(1, limit)
    after = offset + limit
    return df.orderBy(*order).offset(offset).limit(limit), {"total": total, "offset": offset, "limit": limit, "next_offset": after if after < total else None}


def touches(calls: DataFrame, key: str, caller: str, catalog: DataFrame, drop: Column, reads: DataFrame | None = None) -> DataFrame:
    """One row per touch of a catalogued entry: api, caller, dropped, kind (call or read), categories, flags.

    catalog: api, categories, flags (arrays). Calls and field reads are the two sources of touches.
    """
    one = lambda df, kind: df.select(F.col(key).alias("api"), F.col(caller).alias("caller"), drop.alias("dropped"), F.lit(kind).alias("kind"))
    both = one(calls, "call") if reads is None else one(calls, "call").unionByName(one(reads, "read"))
    return both.join(catalog, "api")


def only_categories(catalog: DataFrame, tags: list[str], vocabulary: list[str]) -> DataFrame:
    """Entries with a tag on either axis; an unknown tag raises, unless there is no vocabulary."""
    unknown = sorted(set(tags) - set(vocabulary))
    if vocabulary and unknown:
        raise ValueError(f"unknown tags: {unknown}")
    return catalog.where(F.arrays_overlap(F.concat("categories", "flags"), F.array(*[F.lit(t) for t in tags])))


def capability_counts(t: DataFrame) -> DataFrame:
    """axis, tag, n_touches (once a touch and distinct tag), n_callers, of touches that stay."""
    tags = lambda axis, c: F.transform(F.array_distinct(c), lambda x: F.struct(F.lit(axis).alias("axis"), x.alias("tag")))
    long = t.where(~F.col("dropped")).select("caller", F.explode(F.concat(tags("category", F.col("categories")), tags("flag", F.col("flags")))).alias("t"))
    return long.groupBy("t.axis", "t.tag").agg(F.count(F.lit(1)).alias("n_touches"), F.count_distinct("caller").alias("n_callers"))


def capability_apis(t: DataFrame, limit: int) -> DataFrame:
    """api, calls, reads, callers, truncated: most touches first, then api; entries without a kept touch go."""
    per = t.where(~F.col("dropped")).groupBy("api").agg(F.count_if(F.col("kind") == "call").alias("calls"), F.count_if(F.col("kind") == "read").alias("reads"), F.count_distinct("caller").alias("callers"))
    limit = max(1, limit)
    few = per.orderBy(F.desc(F.col("calls") + F.col("reads")), "api").limit(limit + 1)  # one more than asked for tells whether there are more
    place = F.row_number().over(Window.orderBy(F.desc(F.col("calls") + F.col("reads")), F.col("api")))
    more = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) > limit
    return few.withColumn("_r", place).withColumn("truncated", more).where(F.col("_r") <= limit).drop("_r")


def capability_by_caller(t: DataFrame) -> DataFrame:
    """caller, apis (sorted set)."""
    return t.where(~F.col("dropped")).groupBy("caller").agg(F.sort_array(F.collect_set("api")).alias("apis"))


def dropped(t: DataFrame) -> DataFrame:
    """Touches and entries that the filter removed; an entry is dropped if it had touches and keeps none."""
    return t.groupBy("api").agg(F.sum(F.col("dropped").cast("long")).alias("dropped_touches"), F.count(F.lit(1)).alias("touches"), F.bool_and("dropped").alias("api_dropped"))


def package_prefixes(df: DataFrame, dotted: Column) -> DataFrame:
    """Every dotted prefix of each name, lower-cased, distinct; names with a label outside [a-z0-9_$]+ have none."""
    labels = F.split(F.lower(dotted), r"\.")
    good = F.forall(labels, lambda x: x.rlike(r"^[a-z0-9_$]+\z"))
    return df.where(good).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, 1, k), "."))).alias("prefix")).distinct()
