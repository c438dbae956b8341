"""RDF/XML files of legal acts: description nodes and their predicates, by namespace, streamed."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from candela.sources.archives import _opened

# The namespaces of the graph's model.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
OWL = "http://www.w3.org/2002/07/owl#"
CDM = "http://publications.europa.eu/ontology/cdm#"

NODE = pa.struct([("name", pa.string()), ("target", pa.string())])
NODES_SQL = "path string, node long, about string, aliases array<string>, predicates array<struct<name: string, target: string>>, problem string"
#: Bytes that are given to the parser at a time, and nodes of one batch.
CHUNK, NODES = 1 << 20, 1000


class _Nodes:
    """Collects the children of the document's second level; what is deeper is passed over."""

    def __init__(self):
        self.depth, self.done = 0, []
        self.about, self.aliases, self.predicates = None, [], []
        self.parser = expat.ParserCreate(namespace_separator=" ")
        self.parser.StartElementHandler, self.parser.EndElementHandler = self.start, self.end
        self.parser.EntityDeclHandler = self.entity

    def entity(self, *_) -> None:
        raise ValueError("entity declarations are not read")

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        self.depth += 1
        space, _, local = tag.rpartition(" ")
        if self.depth == 2:
            self.about, self.aliases, self.predicates = attributes.get(f"{RDF} about"), [], []
        elif self.depth == 3:
            target = attributes.get(f"{RDF} resource")
            if (space, local) == (OWL, "sameAs"):
                self.aliases.append(target)
            elif space == CDM:
                self.predicates.append({"name": local, "target": target})

    def end(self, tag: str) -> None:
        if self.depth == 2:
            self.done.append((self.about, self.aliases, self.predicates))
        self.depth -= 1


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths as their nodes; of a file a chunk and a batch of nodes are held."""
    names = ["path", "node", "about", "aliases", "predicates", "problem"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(NODE), pa.string()]

    def told(path: str, first: int, nodes: list, problem: str | None = None) -> pa.RecordBatch:
        rows = [(path, first + k, *n, None) for k, n in enumerate(nodes)] + [(path, first + len(nodes), None, [], [], problem)] * (problem is not None)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    for batch in batches:
        for path in batch.column(0).to_pylist():
            nodes, at, problem = _Nodes(), 0, None
            system, inner = _opened(path)
            with system.open_input_stream(inner) as f:
                try:
                    while chunk := f.read(CHUNK):
                        nodes.parser.Parse(bytes(chunk), False)
                        if len(nodes.done) >= NODES:
                            yield told(path, at, nodes.done)
                            at += len(nodes.done)
                            nodes.done.clear()
                    nodes.parser.Parse(b"", True)
                except (expat.ExpatError, ValueError) as error:
                    problem = f"no valid RDF/XML: {error}"
            if nodes.done or problem:
                yield told(path, at, nodes.done, problem)


def read_legal_nodes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, problems) of RDF/XML files under a path, for registers.legal_relations.

    Only the document's second level counts: a node nested in another is no
    statement of its own. Predicates are those of the model's namespace,
    whatever prefix a file gives it. A file that is no valid XML, or declares
    entities, is a problem, after the nodes that came before the fault.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    rows = files.mapInArrow(_parsed, NODES_SQL)
    return rows.where("problem IS NULL").select("path", "about", "aliases", "predicates"), rows.where("problem IS NOT NULL").select("path", "problem")
