"""The catalogue of the property graph: vertex labels with their properties and edge labels with their ends and properties."""

import re
from dataclasses import dataclass

from pyspark.sql import types as T

_KINDS = {"long": T.LongType(), "string": T.StringType()}


def _fields(text: str) -> list[T.StructField]:
    return [T.StructField(n, _KINDS[k]) for n, k in (f.split(":") for f in text.split())]


#: Vertex labels and their properties. Dates are epoch milliseconds; birthday is yyyymmdd.
VERTICES = {
    "Person": "id:long firstName:string lastName:string gender:string birthday:long creationDate:long browserUsed:string locationIP:string",
    "Message": "id:long label:string creationDate:long content:string imageFile:string length:long language:string browserUsed:string locationIP:string",
    "Forum": "id:long title:string creationDate:long",
    "Organisation": "id:long type:string name:string url:string",
    "Place": "id:long type:string name:string url:string",
    "Tag": "id:long name:string url:string",
    "TagClass": "id:long name:string url:string",
}
#: Labels whose vertices are those rows of another table that have this label.
KINDS = {"Post": "Message", "Comment": "Message"}


@dataclass(frozen=True)
class EdgeType:
    label: str
    source: str
    target: str
    properties: str = ""


#: Edge labels, their ends and their properties.
EDGES = (
    EdgeType("knows", "Person", "Person", "creationDate:long"),
    EdgeType("hasCreator", "Message", "Person"),
    EdgeType("hasTag", "Message", "Tag"),
    EdgeType("hasType", "Tag", "TagClass"),
    EdgeType("isSubclassOf", "TagClass", "TagClass"),
    EdgeType("hasInterest", "Person", "Tag"),
    EdgeType("replyOf", "Message", "Message"),
    EdgeType("likes", "Person", "Message", "creationDate:long"),
    EdgeType("hasMember", "Forum", "Person", "joinDate:long"),
    EdgeType("hasModerator", "Forum", "Person"),
    EdgeType("containerOf", "Forum", "Message"),
    EdgeType("isLocatedIn", "Person", "Place"),
    EdgeType("isLocatedIn", "Message", "Place"),
    EdgeType("isLocatedIn", "Organisation", "Place"),
    EdgeType("isPartOf", "Place", "Place"),
    EdgeType("workAt", "Person", "Organisation", "workFrom:long"),
    EdgeType("studyAt", "Person", "Organisation", "classYear:long"),
)


def column(prop: str) -> str:
    """The column that queries know a property by: first_name for firstName."""
    return re.sub(r"(?<=[a-z])(?=[A-Z])", "_", prop).lower()


def vertex_schema(label: str) -> T.StructType:
    """Fails for an unknown label."""
    if label not in VERTICES:
        raise KeyError(f"no vertex label {label!r}")
    return T.StructType(_fields(VERTICES[label]))


def edge_schema(label: str, source: str | None = None) -> T.StructType:
    """Fails for an unknown label, or if several sources have it and none is named."""
    found = [e for e in EDGES if e.label == label and source in (None, e.source)]
    if len(found) != 1:
        raise KeyError(f"{'no' if not found else 'more than one'} edge label {label!r}" + f" from {source!r}" * (source is not None))
    return T.StructType([*_fields("src:long dst:long"), *_fields(found[0].properties)])
