"""RDF/XML by namespace: other prefixes, nested nodes, damaged files."""

from candela.sources import legal_xml, registers

HEAD = '<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:m="http://publications.europa.eu/ontology/cdm#" xmlns:cdm="http://elsewhere/cdm#">'
ACT = "http://x/resource/celex/"


def test_predicates_count_by_namespace_and_at_the_second_level(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        f'{HEAD}<rdf:Description rdf:about="{ACT}A"><m:work_cites_work rdf:resource="{ACT}B"/><cdm:work_cites_work rdf:resource="{ACT}C"/><m:unknown rdf:resource="{ACT}D"/>'
        f'<m:amends><rdf:Description rdf:about="{ACT}A"><m:amends rdf:resource="{ACT}E"/></rdf:Description></m:amends></rdf:Description>'
        f'<m:other rdf:about="http://y/1"><owl:sameAs rdf:resource="{ACT}F"/><m:amends rdf:resource="{ACT}G?x=1"/><m:amends rdf:resource="{ACT}F"/></m:other></rdf:RDF>'
    )
    (tmp_path / "b.xml").write_text(f'{HEAD}<rdf:Description rdf:about="{ACT}H"><m:corrects rdf:resource="{ACT}I"/></rdf:Description><broken')
    (tmp_path / "c.xml").write_text('<!DOCTYPE x [<!ENTITY e "boom">]><x>&e;</x>')
    nodes, problems = legal_xml.read_legal_nodes(spark, str(tmp_path))
    got = {(r.subject, r.relation, r.target) for r in registers.legal_relations(nodes, registers.relation_table(spark)).collect()}
    assert got == {("A", "CITES", "B"), ("F", "AMENDS", "G"), ("H", "CORRECTS", "I")}
    assert sorted(r.path[-5:] for r in problems.collect()) == ["b.xml", "c.xml"]


def test_many_nodes_are_streamed(spark, tmp_path, monkeypatch):
    body = "".join(f'<rdf:Description rdf:about="{ACT}{k}"><m:amends rdf:resource="{ACT}{k + 1}"/></rdf:Description>' for k in range(30_000))
    (tmp_path / "a.xml").write_text(f"{HEAD}{body}</rdf:RDF>")
    nodes, problems = legal_xml.read_legal_nodes(spark, str(tmp_path / "a.xml"))
    assert nodes.count() == 30_000 and problems.count() == 0


def test_the_relation_table_has_no_doubt():
    assert len(registers.LEGAL_RELATIONS) == 24


def test_acts_are_written_in_few_files(spark, monkeypatch):
    from pathlib import Path

    from candela.plans import feed_queries

    read, paths = legal_xml.read_legal_nodes, []
    monkeypatch.setattr(legal_xml, "read_legal_nodes", lambda s, path: paths.append(path) or read(s, path))
    feed_queries.src_legal_xml(spark, "/root/testdata/sf0.01")
    assert 1 <= len(list(Path(paths[0].removeprefix("file:")).rglob("part-*"))) <= 4
