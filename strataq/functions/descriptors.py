"""Type descriptors as columns: Java names, prototypes, access flags, framework tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Primitive descriptors.
PRIMITIVES = {"V": "void", "Z": "boolean", "B": "byte", "S": "short", "C": "char", "I": "int", "J": "long", "F": "float", "D": "double"}


#: Class prefixes of the platform, and (other) prefixes of callers that are library code.
FRAMEWORK = ("Landroid/", "Ljava/", "Ljavax/", "Lkotlin/", "Lkotlinx/", "Lorg/json/", "Lorg/xml/", "Lorg/w3c/", "Ldalvik/", "Llibcore/", "Lsun/", "Lcom/google/android/")
LIBRARY_CALLERS = ("Landroidx/", "Landroid/support/", "Landroid/arch/", "Lkotlin/", "Lkotlinx/", "Ljava/", "Ljavax/", "Ldalvik/", "Lcom/google/android/", "Lcom/google/common/", "Lcom/google/gson/")
#: Access flag bits and names of classes, fields and methods.
CLASS_FLAGS = {0x1: "public", 0x2: "private", 0x4: "protected", 0x8: "static", 0x10: "final", 0x200: "interface", 0x400: "abstract", 0x1000: "synthetic", 0x2000: "annotation", 0x4000: "enum"}
FIELD_FLAGS = {0x1: "public", 0x2: "private", 0x4: "protected", 0x8: "static", 0x10: "final", 0x40: "volatile", 0x80: "transient", 0x1000: "synthetic", 0x4000: "enum"}
METHOD_FLAGS = {0x1: "public", 0x2: "private", 0x4: "protected", 0x8: "static", 0x10: "final", 0x20: "synchronized", 0x40: "bridge", 0x80: "varargs", 0x100: "native", 0x400: "abstract", 0x800: "strictfp", 0x1000: "synthetic", 0x10000: "constructor", 0x20000: "declared_synchronized"}


def _element(d: Column) -> Column:
    return F.regexp_replace(d, r"^\[+", "")


def descriptor_to_java(d: Column) -> Column:
    """[Ljava/lang/String; -> java.lang.String[]; an element that is no descriptor stays, its dimensions still go behind."""
    e = _element(d)
    prim = F.create_map(*[F.lit(x) for kv in PRIMITIVES.items() for x in kv])
    inner = F.translate(F.substring(e, F.lit(2), F.char_length(e) - 2), "/", ".")
    name = F.when(e.startswith("L") & e.endswith(";"), inner).otherwise(F.coalesce(F.element_at(prim, e), e))
    return F.concat(name, F.repeat(F.lit("[]"), F.char_length(d) - F.char_length(e)))


def java_to_descriptor(n: Column) -> Column:
    tail = F.regexp_extract(n, r"((?:\[\])*)$", 1)
    base = F.substring(n, F.lit(1), F.char_length(n) - F.char_length(tail))
    prim = F.create_map(*[F.lit(x) for k, v in PRIMITIVES.items() for x in (v, k)])
    one = F.coalesce(F.element_at(prim, base), F.concat(F.lit("L"), F.translate(base, ".", "/"), F.lit(";")))
    return F.concat(F.repeat(F.lit("["), F.floor(F.char_length(tail) / 2).cast("int")), one)


def is_proto(p: Column) -> Column:
    """(...)R whose parameters can be told apart: no dangling [ and no L without its ;."""
    return p.rlike(r"^\((?:\[*(?:L[^;)]*;|[^\[L)]))*\)")


def proto_params(p: Column) -> Column:
    """array<string> of the parameter descriptors of (...)R; NULL if it is malformed."""
    inner = F.regexp_extract(p, r"^\(([^)]*)\)", 1)
    return F.when(is_proto(p), F.regexp_extract_all(inner, F.lit(r"(\[*(?:L[^;]*;|[^\[L]))"), F.lit(1)))


def proto_return(p: Column) -> Column:
    return F.when(is_proto(p), F.regexp_extract(p, r"^[^)]*\)(.*)$", 1))


def _java_args(p: Column) -> Column:
    return F.array_join(F.transform(proto_params(p), descriptor_to_java), ", ")


def pretty_proto(p: Column) -> Column:
    """(int, long[]) -> void; NULL if the proto is malformed (see require_proto)."""
    return F.concat(F.lit("("), _java_args(p), F.lit(") -> "), descriptor_to_java(proto_return(p)))


def require_proto(p: Column) -> Column:
    """The proto itself; a malformed one fails the query."""
    return F.when(p.isNull() | is_proto(p), p).otherwise(F.raise_error(F.concat(F.lit("malformed proto: "), p)).cast("string"))


def method_java(cls: Column, name: Column, proto: Column) -> Column:
    return F.concat(descriptor_to_java(cls), F.lit("."), name, F.lit("("), _java_args(proto), F.lit(") -> "), descriptor_to_java(proto_return(proto)))


def method_signature(cls: Column, name: Column, proto: Column) -> Column:
    return F.concat(cls, F.lit("->"), name, proto)


def field_signature(cls: Column, name: Column, kind: Column) -> Column:
    return F.concat(cls, F.lit("->"), name, F.lit(":"), kind)


def enrich_method(cls: Column, name: Column, proto: Column) -> list[Column]:
    """Derived columns of a method reference."""
    return [
        descriptor_to_java(cls).alias("java_class"), proto_params(proto).alias("parameters"), proto_return(proto).alias("return_type"),
        method_java(cls, name, proto).alias("java_signature"), (name == "<init>").alias("is_constructor"),
        (name == "<clinit>").alias("is_static_initializer"), method_signature(cls, name, proto).alias("signature"),
    ]


def is_type_descriptor(d: Column) -> Column:
    """A primitive, an L...; without a dot and with a name, or arrays of them. A space inside is legal."""
    return d.rlike(r"(?s)^\[*(?:L[^.]+;|[VZBSCIJFD])\z")


def is_member_descriptor(d: Column) -> Column:
    """Lcls;->name(proto)ret or Lcls;->name:type."""
    cls = F.substring_index(d, "->", 1)
    rest = F.substring(d, F.char_length(cls) + 3, F.char_length(d))
    field = F.contains(rest, F.lit(":")) & is_type_descriptor(F.substring_index(rest, ":", -1))
    return F.contains(d, F.lit("->")) & is_type_descriptor(cls) & (F.contains(rest, F.lit("(")) | field)


def require_type(d: Column) -> Column:
    return F.when(is_type_descriptor(d), d).otherwise(F.raise_error(F.concat(F.lit("expected a type descriptor like Ljava/lang/String;, got "), F.coalesce(d, F.lit("null")))).cast("string"))


def require_member(d: Column) -> Column:
    return F.when(is_member_descriptor(d), d).otherwise(F.raise_error(F.concat(F.lit("expected a member descriptor like La/B;->m()V, got "), F.coalesce(d, F.lit("null")))).cast("string"))


def class_name_pattern(q: str) -> str:
    """A class query in L...; form without its wrapper."""
    return q[1:-1] if len(q) >= 2 and q.startswith("L") and q.endswith(";") else q


def class_flag_names(flags: Column) -> Column:
    """Names of a class's flags; an interface is not also called abstract."""
    names = flag_names(flags, CLASS_FLAGS)
    return F.when(flags.bitwiseAND(F.lit(0x200)) != 0, F.array_remove(names, "abstract")).otherwise(names)


def is_framework(d: Column) -> Column:
    """A platform type, arrays unwrapped."""
    return _any_prefix(_element(d), FRAMEWORK)


def is_library_caller(d: Column) -> Column:
    """A member or class of bundled library code (a different list, and arrays are not unwrapped)."""
    return _any_prefix(d, LIBRARY_CALLERS)


def _any_prefix(c: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def flag_names(flags: Column, table: dict[int, str]) -> Column:
    """Names of the bits that are set; null flags stay null."""
    return F.when(flags.isNotNull(), F.array_compact(F.array(*[F.when(flags.bitwiseAND(F.lit(b)) != 0, F.lit(n)) for b, n in sorted(table.items())])))
