"""References between documents as an edge table; resolving one and finding usages are joins.

All functions take documents as ``sources.documents.checked`` gives them (path, v, resource_type, doc_error).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.compiler import Resolver, fhirpath
from ..plans.shared import materialized
from ..plans.syntax import Binary, Call, Index, Member, Name, TypeTest, parse
from ..plans.values import let
from ..sources.documents import as_written, is_object, schema_of, typed


def _get(v: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, kind)


def _text(v: Column | str, path: str) -> Column:
    """A text at a path; null for anything else, numbers too."""
    return _of_text(_get(v, path, "variant"))


def _of_text(at: Column) -> Column:
    return F.when(F.schema_of_variant(at) == "STRING", at.try_cast("string"))


def flavor(raw: Column) -> Column:
    """How a reference text names its target."""
    return (
        F.when(raw.startswith("#"), "contained").when(raw.startswith("urn:uuid:"), "urn-uuid").when(_absolute(raw), "absolute")
        .when(raw.rlike(r"^[A-Za-z]\w*/.+"), "relative").otherwise("unknown")
    )


def _absolute(raw: Column) -> Column:
    return raw.startswith("http://") | raw.startswith("https://")


def label(v: Column, resource_type: Column, id_: Column, fallback: Column) -> Column:
    """code.text, the first coding's display, or the first name; else the fallback."""
    given, family = _text(v, "$.name[0].given[0]"), _text(v, "$.name[0].family")
    name = F.coalesce(_text(v, "$.name[0].text"), F.concat_ws(" ", given, family))
    human = F.coalesce(_text(v, "$.code.text"), _text(v, "$.code.coding[0].display"), F.nullif(name, F.lit("")))
    # null where ``human`` is, which stands here once and so is computed once
    marked = F.concat(F.lit("["), F.coalesce(resource_type, F.lit("null")), F.lit("] "), human, F.lit(" ("), F.coalesce(id_, F.lit("?")), F.lit(")"))
    return F.coalesce(marked, fallback)


def held() -> Column:
    """The (position, element_path, resource_type, id) of ``resources`` as an array in the row of their document, which is parsed once and stays where it is."""
    one = lambda v, n, place: F.struct(n.alias("position"), place.alias("element_path"), _text(v, "$.resourceType").alias("resource_type"), _text(v, "$.id").alias("id"))
    entry = lambda v, n: F.when(is_object(v), one(v, n, F.format_string("Bundle.entry[%d].resource", n)))
    entries = F.transform(_get("v", "$.entry", "array<variant>"), lambda e, n: let(_get(e, "$.resource", "variant"), lambda v: entry(v, n)))
    return F.when(F.col("resource_type") == "Bundle", F.array_compact(entries)).otherwise(F.array(one(F.col("v"), F.lit(0), F.col("resource_type"))))


def resources(docs: DataFrame) -> DataFrame:
    """(path, position, element_path, resource_type, id, full_url, label, v): the entries of bundles, and all other documents.

    One pass over the documents, which need not be written before: nothing is filtered until their resources are rows, since a filter by what was parsed would be
    computed below the parsing, and so parse the texts again.
    """
    one = lambda n, url, v: F.struct(n.alias("position"), url.alias("full_url"), v.alias("v"))
    entry = lambda e, n: let(_get(e, "$.resource", "variant"), lambda v: F.when(is_object(v), one(n, _text(e, "$.fullUrl"), v)))
    entries = F.array_compact(F.transform(_get("v", "$.entry", "array<variant>"), entry))
    root = F.array(one(F.lit(0), F.lit(None).cast("string"), F.col("v")))
    inside = F.col("root_type") == "Bundle"
    rows = docs.select("path", F.col("resource_type").alias("root_type"), F.explode(F.when(F.col("doc_error").isNull(), F.when(F.col("resource_type") == "Bundle", entries).otherwise(root))).alias("x"))
    place = F.when(inside, F.format_string("Bundle.entry[%d].resource", "x.position")).otherwise(F.col("root_type"))
    out = rows.select("path", "x.position", place.alias("element_path"), "x.full_url", "x.v").withColumns({"resource_type": _text("v", "$.resourceType"), "id": _text("v", "$.id")})
    plain = F.concat(F.coalesce("resource_type", F.lit("?")), F.lit("/"), F.coalesce("id", F.lit("?")))
    return out.withColumn("label", label(F.col("v"), F.col("resource_type"), F.col("id"), plain)).select("path", "position", "element_path", "resource_type", "id", "full_url", "label", "v")


def outline(docs: DataFrame) -> DataFrame:
    """(path, position, identity, label): resources that have an identity, by Type/id or else fullUrl."""
    named = F.concat("resource_type", F.lit("/"), "id")
    rows = resources(docs).withColumn("identity", F.coalesce(named, "full_url")).where("identity is not null")
    return rows.select("path", "position", "identity", label(F.col("v"), F.col("resource_type"), F.col("id"), F.col("identity")).alias("label"))


def identities(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(identity, path, element_path, position): Type/id and fullUrl of every resource, and Type/id of bundles themselves. Of one
    identity in one document the last resource stays."""
    r = resources(docs) if found is None else found
    one = r.where("resource_type is not null and id is not null").select(F.concat("resource_type", F.lit("/"), "id").alias("identity"), "path", "element_path", "position")
    two = r.where("full_url is not null").select(F.col("full_url").alias("identity"), "path", "element_path", "position")
    bundle = docs.where("doc_error is null and resource_type = 'Bundle'").select(F.concat(F.lit("Bundle/"), _text("v", "$.id")).alias("identity"), "path", F.lit("Bundle").alias("element_path"), F.lit(-1).alias("position"))
    every = one.union(two).union(bundle.where("identity is not null"))
    return every.groupBy("identity", "path").agg(F.max(F.struct("position", "element_path")).alias("x")).select("identity", "path", "x.element_path", "x.position")


def contained(found: DataFrame) -> DataFrame:
    """(path, owner_path, contained_id, element_path) of contained resources with an id; of equal ids the last."""
    rows = found.select("path", F.col("element_path").alias("owner_path"), F.posexplode(_get("v", "$.contained", "array<variant>")).alias("n", "c"))
    rows = rows.withColumn("contained_id", _text("c", "$.id")).where("contained_id is not null").groupBy("path", "owner_path", "contained_id").agg(F.max("n").alias("n"))
    return rows.select("path", "owner_path", "contained_id", F.format_string("%s.contained[%d]", "owner_path", "n").alias("element_path"))


def reference_places(value: object, place: str) -> Iterator[tuple[str, str]]:
    """The place and text of every text under a key ``reference``, at any depth."""
    left = [(place, value)]
    while left:
        at, v = left.pop()
        if isinstance(v, dict):
            for key, inner in v.items():
                if key == "reference" and isinstance(inner, str):
                    yield f"{at}.{key}", inner
                elif isinstance(inner, dict | list):
                    left.append((f"{at}.{key}", inner))
        elif isinstance(v, list):
            left += [(f"{at}[{n}]", inner) for n, inner in enumerate(v) if isinstance(inner, dict | list)]


def references(found: DataFrame) -> DataFrame:
    """(path, owner_path, owner_type, owner_id, element_path, raw, flavor) of every text under a key ``reference``, at any depth.

    One pass over the resources, without a shuffle: those whose JSON holds the key at all are walked where they are. What is found is written once: ``resolve`` reads
    it twice, and would walk the resources twice.
    """
    names = ["path", "owner_path", "owner_type", "owner_id", "element_path", "raw"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, texts, rows, places, raws = batch.column("owner_path").to_pylist(), batch.column("json").to_pylist(), [], [], []
            for n, (owner, text) in enumerate(zip(owners, texts, strict=True)):
                for place, raw in reference_places(json.loads(text), owner):
                    rows.append(n)
                    places.append(place)
                    raws.append(raw)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in names[:4]), pa.array(places, pa.string()), pa.array(raws, pa.string())], names)

    rows = found.select("path", F.col("element_path").alias("owner_path"), F.col("resource_type").alias("owner_type"), F.col("id").alias("owner_id"), F.to_json("v").alias("json"))
    rows = rows.where(F.contains("json", F.lit('"reference"'))).mapInArrow(walk, ", ".join(f"{n} string" for n in names))
    return materialized(rows.withColumn("flavor", flavor(F.col("raw"))), "references")


def _tail(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(F.substring_index(raw, "/", -2), r"([A-Za-z]\w*/[^/]+)$", 1), F.lit(""))


def _own_name(owner: Column, id_: Column) -> Column:
    """What a contained resource is called in the table of names, which no identity is."""
    return F.concat(F.lit("#"), owner, F.lit("#"), id_)


def resolve(refs: DataFrame, ids: DataFrame, inside: DataFrame) -> DataFrame:
    """``refs`` with target_path, target_element and candidates (documents that hold the identity): nulls where nothing fits.

    Contained references stay in their owner; others look into their own document first, then into all, where the lowest path wins. An
    absolute one that is not found as it stands is looked up by its last two parts. Names in the own document, contained ones among them, are one
    join, names anywhere another; only absolute references that their own document lacks are joined again, by their last parts. Nothing is written.
    """
    own = inside.select("path", _own_name(F.col("owner_path"), F.col("contained_id")).alias("name"), F.col("element_path").alias("element"))
    local = ids.select("path", F.col("identity").alias("name"), F.col("element_path").alias("element")).unionByName(own)
    every = ids.groupBy(F.col("identity").alias("name")).agg(F.min(F.struct("path", "element_path")).alias("first"), F.count("*").alias("holders"))
    name = F.when(F.col("flavor") == "contained", _own_name(F.col("owner_path"), F.substr("raw", F.lit(2)))).otherwise(F.col("raw"))

    def looked_up(rows: DataFrame, key: Column, here: str, there: str) -> DataFrame:
        """``rows`` with ``here``, the place of the name in its own document, and ``there``, (place, holders) of it in any."""
        rows = rows.withColumn("name", key).join(local.withColumnRenamed("element", here), ["path", "name"], "left")
        return rows.join(every.select("name", F.struct("first", "holders").alias(there)), "name", "left").drop("name")

    met = looked_up(refs.select(F.struct(*refs.columns).alias("ref"), "path", "flavor", name.alias("wanted")), F.col("wanted"), "h0", "t0")
    again = (F.col("flavor") == "absolute") & F.col("h0").isNull() & _tail(F.col("wanted")).isNotNull()
    tailed = looked_up(met.where(again), _tail(F.col("wanted")), "h1", "t1")
    rest = met.where(~again).withColumns({"h1": F.lit(None).cast("string"), "t1": F.lit(None).cast(tailed.schema["t1"].dataType)})
    place = F.coalesce(F.col("h0"), F.col("h1"))
    anywhere = F.when(place.isNull(), F.coalesce(F.col("t0"), F.col("t1")))
    return tailed.unionByName(rest).select(
        "ref.*", F.when(place.isNotNull(), F.col("path")).otherwise(anywhere["first"]["path"]).alias("target_path"), F.coalesce(place, anywhere["first"]["element_path"]).alias("target_element"),
        F.when(place.isNotNull(), 1).otherwise(F.coalesce(anywhere["holders"], F.lit(0))).cast("long").alias("candidates"),
    )


def usages(resolved: DataFrame, found: DataFrame, ids: DataFrame) -> DataFrame:
    """(target_path, target_element, path, owner_type, owner_id, element_path, raw): who refers to each resource.

    In the resource's own document by resolution (contained ones are no usages), in others by a text equal to one of its identities.
    """
    outside = resolved.where("flavor <> 'contained'")
    local = outside.where("target_path = path").select("target_path", "target_element", "path", "owner_type", "owner_id", "element_path", "raw")
    names = ids.select(F.col("identity").alias("raw"), F.col("path").alias("target_path"), F.col("element_path").alias("target_element"))
    far = outside.drop("target_path", "target_element").join(names, "raw").where("target_path <> path").select(*local.columns)
    return local.unionByName(far).join(found.select(F.col("path").alias("target_path"), F.col("element_path").alias("target_element")), ["target_path", "target_element"], "left_semi")


def unresolved(resolved: DataFrame) -> DataFrame:
    return resolved.where("target_path is null")


#: Resources, contained ones too, of a document at most whose references to each other are looked up within its row (fixed value): a look at each, for each
#: reference. Those of larger documents are joined.
NEAR = 64
#: Targets in other documents, and their bytes as JSON, at most (fixed values) that are one map, a copy for each row and a look at each for each reference. More are joined.
FAR, FAR_BYTES = 256, 1 << 14
_ITEMS = "array<struct<position:int,element_path:string,owner:string,name:string,full_url:string,v:variant>>"


def _members(docs: DataFrame) -> DataFrame:
    """(path, items, names): a row for each document with its resources, each followed by the objects that it contains. Of a bundle itself there is one without ``v``.

    Items: position (of contained ones that in their owner), element_path, owner (the element path of the resource that contains it), name (Type/id; of contained ones
    ``_own_name``), full_url and v. Names: both of each item, from the last one on, so that the first that fits counts. What else begins with # names nothing. One
    pass over the documents, which need not be written before; nothing is filtered, see ``resources``.
    """
    none = F.lit(None).cast("string")
    outside = lambda name: F.when(~name.startswith("#"), name)

    def item(position: Column, place: Column, v: Column, owner: Column = none, name: Column = none, url: Column = none) -> Column:
        fields = {"position": position, "element_path": place, "owner": owner, "name": name, "full_url": url, "v": v}
        return F.struct(*(x.alias(n) for n, x in fields.items()))

    def with_contained(v: Column, position: Column, place: Column, url: Column) -> Column:
        """The items of a resource, null where it is no object: one cast tells that, and what of it is needed."""

        def inner(c: Column, n: Column) -> Column:
            at = F.concat(place, F.lit(".contained["), n.cast("string"), F.lit("]"))
            return let(c.try_cast("struct<id:variant>"), lambda x: F.when(x.isNotNull(), item(n, at, c, owner=place, name=_own_name(place, _of_text(x["id"])))))

        def made(x: Column) -> Column:
            name = F.concat(_of_text(x["resourceType"]), F.lit("/"), _of_text(x["id"]))
            own = F.array(item(position, place, v, name=name, url=url))
            return F.when(x.isNotNull(), F.when(x["contained"].isNull(), own).otherwise(F.flatten(F.array(own, F.array_compact(F.transform(x["contained"], inner))))))

        return let(v.try_cast("struct<resourceType:variant,id:variant,contained:array<variant>>"), made)

    def of_entry(e: Column, n: Column) -> Column:
        return let(F.concat(F.lit("Bundle.entry["), n.cast("string"), F.lit("].resource")), lambda place: with_contained(e["resource"], n, place, _of_text(e["fullUrl"])))

    v, kind = F.col("v"), F.col("resource_type")
    itself = item(F.lit(-1), kind, F.lit(None).cast("variant"), name=F.concat(F.lit("Bundle/"), _text(v, "$.id")))
    entries = F.flatten(F.array_compact(F.transform(_get(v, "$.entry", "array<struct<fullUrl:variant,resource:variant>>"), of_entry)))
    bundle = F.flatten(F.array(F.array(itself), F.coalesce(entries, F.array().cast(_ITEMS))))
    alone = with_contained(v, F.lit(0), kind, none)
    items = docs.select("path", F.when(F.col("doc_error").isNull(), F.when(kind == "Bundle", bundle).otherwise(alone)).alias("items"))
    return items.withColumn("names", F.reverse(F.flatten(F.transform("items", lambda x: F.array(F.coalesce(F.when(x["owner"].isNotNull(), x["name"]), outside(x["name"])), outside(x["full_url"]))))))


class Targets:
    """The resources of documents, as rows to evaluate paths on and as what resolve() finds.

    ``rows``: (path, element_path, resource, and near where the documents are plain), the resource typed by ``type``, which holds all of them, contained ones too.
    ``type`` may be given. Documents are plain where it is not, and nothing in them is of mixed kinds or a decimal: then they stay as they are written, and fields
    are taken from them where they are named. ``near``: names and values of the row's document, unless it has more than ``NEAR`` resources. Fields of targets that a path does not
    name are left out by ``paths``.
    """

    def __init__(self, docs: DataFrame, type_: T.StructType | None = None):
        self.documents = materialized(_members(docs), "members")
        of_all = self.documents.select(F.size("items").alias("n"), F.explode("items.v").alias("v")).agg(F.schema_of_variant_agg("v").alias("s"), F.max("n").alias("n")).first()
        self.type, self.large = type_ or schema_of(of_all["s"]), (of_all["n"] or 0) > NEAR
        self.plain = type_ is None and bool(self.type.fields) and not as_written(self.type) and not any("'" in f.name for f in self.type.fields)
        near = F.when(F.size("items") <= NEAR, F.struct("names", F.col("items.v").alias("values")))
        items = self.documents.select("path", near.alias("near"), F.explode("items").alias("x")).where("x.v is not null")
        self._items, inside = items.drop("near"), F.col("x.owner").isNotNull()
        if self.plain:  # each field by itself, so that those that are not named are not read
            resource = F.struct(*(_get("x.v", f"$['{f.name}']", f.dataType.simpleString()).alias(f.name) for f in self.type.fields)).alias("resource")
            self.all = self._items.select("path", "x.element_path", inside.alias("inside"), resource)
            self.rows = items.where(~inside).select("path", "x.element_path", resource, "near")
        else:  # typed and written once: later reads take the fields that they need
            self.all = materialized(typed(self._items.select("path", "x.element_path", inside.alias("inside"), F.to_json("x.v").alias("json")), self.type).drop("json"), "typed")
            self.rows = self.all.where("not inside").drop("inside")

    def _named(self) -> DataFrame:
        """(name, path, x) of all identities."""
        every = self.documents.select("path", F.explode("items").alias("x")).where("x.owner is null")
        return every.select(F.explode(F.array_distinct(F.array_compact(F.array("x.name", "x.full_url")))).alias("name"), "path", "x")

    @cached_property
    def identities(self) -> DataFrame:
        rows = self._named().groupBy(F.col("name").alias("identity"), "path").agg(F.max(F.struct("x.position", "x.element_path")).alias("x"))
        return materialized(rows.select("identity", "path", "x.element_path", "x.position"), "identities")

    @cached_property
    def contained(self) -> DataFrame:
        rows = self._items.where("x.owner is not null and x.name is not null").groupBy("path", F.col("x.owner").alias("owner_path"), F.expr("substr(x.name, length(x.owner) + 3)").alias("contained_id"))
        return materialized(rows.agg(F.max_by("x.element_path", "x.position").alias("element_path")), "contained")

    def _kept(self, names: set[str] | None) -> T.StructType:
        return T.StructType([f for f in self.type.fields if names is None or f.name in ("resourceType", "id", *names) or any(f.name.startswith(n) and f.name[len(n)].isupper() for n in names)])

    def resolver(self, names: set[str] | None = None, owner: str = "element_path") -> tuple[Resolver, T.StructType]:
        """A resolver for ``fhirpath`` and the type of what it finds: all fields, or those that ``names`` can mean. The rows need path and element_path, which
        together are a key; ``owner``: the column of the resource that a row belongs to, in which #names are looked up."""
        target = self._kept(names)
        held = self.all.select(F.col("path").alias("target_path"), F.col("element_path").alias("target_element"), F.struct(*(F.col("resource")[f.name].alias(f.name) for f in target)).alias("target"))

        def attach(df: DataFrame, name: str, texts: list[str]) -> DataFrame:
            wanted = df.select("path", "element_path", F.col(owner).alias("owner_path"), F.explode(F.array_distinct(F.concat(*texts))).alias("raw")).distinct()
            met = resolve(wanted.withColumn("flavor", flavor(F.col("raw"))), self.identities, self.contained).where("target_path is not null")
            # one row for each text of a row that is found, at most as many as the row's path yields
            maps = met.join(held, ["target_path", "target_element"]).groupBy("path", "element_path").agg(F.map_from_entries(F.collect_list(F.struct("raw", "target"))).alias(name))
            return df.join(materialized(maps, "targets"), ["path", "element_path"], "left")  # written, so that the next level's join computes none of this again

        return attach, target

    def near_resolver(self, names: set[str] | None = None) -> tuple[Resolver, T.StructType]:
        """As ``resolver``, for rows of plain documents that have ``near``. A reference is looked up there first, without a join; what is not there by its name, in
        all documents, and of an absolute one by its last parts: distinct names are joined to their holders, where the lowest path wins and in it the last resource."""
        target, none = self._kept(names), F.lit(None).cast("string")
        contained = lambda raw: raw.startswith("#")
        tail = lambda raw: F.when(_absolute(raw), _tail(raw))
        at = lambda name: F.nullif(F.array_position("near.names", name), F.lit(0))
        value = lambda n: F.get(F.col("near.values"), ((F.size("near.names") - n) / 2).cast("int")).try_cast(target)
        place = lambda raw: F.when(contained(raw), at(F.concat(F.lit("#"), F.col("element_path"), raw))).otherwise(F.coalesce(at(raw), at(tail(raw))))

        def attach(df: DataFrame, name: str, texts: list[str]) -> DataFrame:
            raws = F.array_except(F.concat(*texts), F.array(none))  # distinct ones, no nulls
            refs = df.select("path", "element_path", "near", F.explode(raws).alias("raw")).where(~contained(F.col("raw")) & place(F.col("raw")).isNull())
            refs = refs.select("path", "element_path", "raw", F.posexplode(F.array(F.col("raw"), tail(F.col("raw")))).alias("rank", "name")).where("name is not null")
            wanted = materialized(refs.select("name").distinct(), "wanted")
            first = F.min_by(F.struct(F.col("x.v").try_cast(target).alias("target")), F.struct("path", -F.col("x.position")))
            far = materialized(self._named().join(wanted, "name").groupBy("name").agg(first.alias("first")), "far")
            n, size = far.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json("first"))), F.lit(0))).first()
            df = df.withColumn("raws", raws)
            if n <= FAR and size <= FAR_BYTES:
                known = far.agg(F.map_from_entries(F.collect_list(F.struct("name", "first"))).alias("known"))
                away = lambda raw: F.coalesce(F.try_element_at("known", raw), F.try_element_at("known", tail(raw)))["target"]
                found = lambda raw: let(place(raw), lambda n: F.when(n.isNotNull(), value(n)).when(~contained(raw), away(raw)))
                return df.crossJoin(F.broadcast(known)).withColumn(name, F.map_from_arrays("raws", F.transform("raws", found))).drop("raws", "known")
            # one row for each text of a row that is found, at most as many as the row's path yields
            firsts = refs.join(far, "name").groupBy("path", "element_path", "raw").agg(F.min_by("first", "rank").alias("first")).where("first.target is not null")
            maps = firsts.groupBy("path", "element_path").agg(F.map_from_entries(F.collect_list(F.struct("raw", "first.target"))).alias("away"))
            near = F.transform("raws", lambda raw: F.struct(raw.alias("raw"), let(place(raw), value).alias("target")))
            df = df.withColumn(name, F.map_from_entries(F.filter(near, lambda e: e["target"].isNotNull()))).drop("raws").join(materialized(maps, "targets"), ["path", "element_path"], "left")
            return df.withColumn(name, F.when(F.col("away").isNull(), F.col(name)).otherwise(F.map_concat(F.col(name), F.col("away")))).drop("away")

        return attach, target

    def paths(self, expression: str, rows: DataFrame | None = None, **options) -> DataFrame:
        """``rows`` (default: all resources) with the result of ``expression``, in which resolve() finds what the references name: in the own resource, the own
        document, or any; see ``resolve``. References of targets are looked up from the row's own place as well."""
        names, rows = _names(parse(expression)), self.rows if rows is None else rows
        run = lambda df, by: fhirpath(df, "resource", expression, resolver=by[0], target=by[1], **options)
        if not self.plain or "near" not in rows.columns:
            return run(rows, self.resolver(names))
        near = run(rows.where("near is not null") if self.large else rows, self.near_resolver(names)).drop("near")
        return near.unionByName(run(rows.where("near is null").drop("near"), self.resolver(names))) if self.large else near


def _names(node, parent=None) -> set[str] | None:
    """The member names of a tree; None where what a resolve() finds, or the whole of an object, can be a result."""
    if isinstance(node, Call) and (node.name in ("children", "descendants", "repeat") or (node.name == "resolve" and not isinstance(parent, Member))):
        return None
    parts = {Member: lambda: (node.source,), Call: lambda: (node.source, *node.args), Index: lambda: (node.source, node.index), Binary: lambda: (node.left, node.right), TypeTest: lambda: (node.source,)}.get(type(node), tuple)()
    found = [_names(x, node) for x in parts if x is not None]
    return None if any(f is None for f in found) else {node.name for _ in (0,) if isinstance(node, Name | Member)}.union(*found)


def owner_path(element_path: Column) -> Column:
    """The element path of the resource that a place belongs to: a bundle's entry, or the document."""
    entry = F.regexp_extract(element_path, r"^(Bundle\.entry\[\d+\]\.resource)", 1)
    return F.when(entry != "", entry).otherwise(F.regexp_extract(element_path, r"^([^.\[]+)", 1))


def locate(places: DataFrame, docs: DataFrame) -> DataFrame:
    """``places`` (path, element_path, ...) with ``found_path``, the deepest part of the place that its document has, ``exact`` and ``node``, its value.

    The resource itself is the least that is found. Documents that are missing give nulls.
    """
    d = docs.where("doc_error is null").select(F.col("path").alias("p"), "v")
    rows = places.join(d, F.col("path") == F.col("p"), "left").drop("p")
    rows = rows.withColumn("steps", F.regexp_extract_all("element_path", F.lit(r"(\.[^.\[\]]+|\[\d+\])"), F.lit(1)))
    upto = lambda n: F.array_join(F.slice("steps", F.lit(1), n), "")
    there = F.filter(F.sequence(F.lit(0), F.size("steps")), lambda n: F.when(n == 0, True).otherwise(F.try_variant_get(F.col("v"), F.concat(F.lit("$"), upto(n)), "variant").isNotNull()))
    rows = rows.withColumn("deepest", F.when(F.col("v").isNotNull(), F.array_max(there)))
    node = F.when(F.col("deepest") == 0, F.col("v")).otherwise(F.try_variant_get(F.col("v"), F.concat(F.lit("$"), upto(F.col("deepest"))), "variant"))
    root = F.regexp_extract("element_path", r"^([^.\[]+)", 1)
    return rows.select(*places.columns, F.concat(root, upto(F.col("deepest"))).alias("found_path"), (F.col("deepest") == F.size("steps")).alias("exact"), node.alias("node"))
