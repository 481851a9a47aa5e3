"""Vocabulary formats, each from a file of a few lines."""

import json

import pytest

from glossa.sources import vocabularies as V


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_diseases(spark, tmp_path):
    lines = [
        {"id": "MONDO_1", "name": "flu", "therapeuticAreas": ["A"], "dbXRefs": ["X:1"], "synonyms": {"hasExactSynonym": ["grippe"]}},
        {"id": "MONDO_2", "name": "other", "therapeuticAreas": ["B"], "dbXRefs": [], "synonyms": {"hasExactSynonym": []}},
    ]
    df = V.diseases_json(spark, put(tmp_path, "d.json", "\n".join(map(json.dumps, lines))), ["A"])
    assert rows(df, "idx", "syn", "mapping_type") == [("MONDO_1", "flu", "name"), ("MONDO_1", "grippe", "hasExactSynonym")]


def test_targets(spark, tmp_path):
    lines = [
        {"id": "E1", "approvedSymbol": "AB1", "approvedName": "ab one", "biotype": "protein", "synonyms": [{"label": "ab", "source": "s"}], "proteinIds": [{"id": "P1", "source": "s"}], "go": "[{}]"},
        {"id": "E2", "approvedSymbol": "E2", "approvedName": "x", "biotype": "protein"},
        {"id": "E3", "approvedSymbol": "C", "approvedName": "x", "biotype": "tec"},
    ]
    df = V.targets_json(spark, put(tmp_path, "t.json", "\n".join(map(json.dumps, lines))), ["tec"])
    assert rows(df, "syn", "annotation_score") == [("AB1", 1), ("E1", 1), ("P1", 1), ("ab", 1), ("ab one", 1)]


def test_molecules(spark, tmp_path):
    df = V.molecules_json(spark, put(tmp_path, "m.json", json.dumps({"id": "C1", "name": "aspirin", "synonyms": ["ASA", "aspirin"], "tradeNames": ["Disprin"]})))
    assert rows(df, "syn", "mapping_type") == [("ASA", "synonyms"), ("Disprin", "tradeNames"), ("aspirin", "synonyms")]


def test_obo_graph(spark, tmp_path):
    nodes = [
        {"id": "http://x/MONDO_1", "lbl": "flu", "meta": {"synonyms": [{"pred": "hasExactSynonym", "val": "grippe"}, {"pred": "hasBroadSynonym", "val": "ill"}]}},
        {"id": "http://x/MONDO_2"},
        {"id": "http://x/UBERON_3", "lbl": "lung"},
    ]
    df = V.obo_graph_json(spark, put(tmp_path, "o.json", json.dumps({"graphs": [{"nodes": nodes}]}, indent=1)))
    assert rows(df, "syn") == [("flu",), ("grippe",)]


def test_genes(spark, tmp_path):
    docs = [{"ensembl_gene_id": "E1", "name": "gene one", "symbol": "G1", "alias_symbol": ["GA", "GB"]}, {"name": "no id", "symbol": "N"}]
    df = V.genes_json(spark, put(tmp_path, "g.json", json.dumps({"response": {"docs": docs}}, indent=1)))
    assert rows(df, "syn") == [("G1",), ("GA",), ("GB",), ("gene one",)]


def test_triples(spark, tmp_path):
    xml = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/">
    <e:C rdf:about="http://e/T_1"><e:label>lung</e:label><e:syn>lungs</e:syn><e:ns rdf:resource="http://e/ok"/></e:C>
    <e:C rdf:about="http://e/T_2"><e:label>obsolete heart</e:label><e:ns rdf:resource="http://e/ok"/></e:C>
    <e:C rdf:about="http://e/T_3"><e:label>leg</e:label></e:C></rdf:RDF>"""
    t = V.triples_xml(spark, put(tmp_path, "x.owl", xml))
    rule = V.RdfRule(r"T_[0-9]+$", "http://e/label", ("http://e/syn",), include=(("http://e/ns", "http://e/ok"),), drop_label="obsolete")
    assert rows(V.rdf_terms(t, rule), "idx", "syn") == [("http://e/T_1", "lung"), ("http://e/T_1", "lungs")]
    paths = spark.createDataFrame([("a", "p", "x"), ("x", "q", "label")], "s string, p string, o string")
    assert rows(V.path_labels(paths, "p", "q"), "s", "label") == [("a", "label")]


def test_stanzas_levels_and_families(spark, tmp_path):
    obo = put(tmp_path, "c.obo", "format-version: 1\n[Term]\nid: C_1\nname: HeLa Cell Line\n[Term]\nid: C_2\nname: K562\n")
    assert rows(V.stanzas_obo(spark, obo), "idx", "syn") == [("C_1", "HeLa"), ("C_2", "K562")]
    atc = put(tmp_path, "a.txt", "A     1ALIMENTARY\nA01AA01     5sodium fluoride\n")
    assert rows(V.levels_txt(spark, atc), "idx", "syn") == [("A01AA01", "sodium fluoride")]
    tsv = "Family ID\tFamily name\tFamily alias\tCommon root gene symbol\n1\tkinases\tK\tKIN\n1\tkinases\tKK\tKIN\n"
    assert rows(V.families_tsv(spark, put(tmp_path, "f.tsv", tsv)), "syn") == [("K",), ("KIN",), ("KK",), ("kinases",)]
    with pytest.raises(Exception, match="several names"):
        V.families_tsv(spark, put(tmp_path, "g.tsv", tsv.replace("kinases\tKK", "others\tKK"))).collect()


def test_hierarchy(spark, tmp_path):
    h = put(tmp_path, "h.asc", "1$10$100$1000$headache$head pains$pains$nervous$\n2$20$200$2000$gone$x$y$excluded$\n")
    low = put(tmp_path, "l.asc", "7$cephalgia$1$\n")
    got = rows(V.hierarchy_asc(spark, h, low, ["excluded"]), "idx", "syn", "mapping_type")
    assert got == [("1", "cephalgia", "link"), ("10", "head pains", "hlt"), ("100", "pains", "hlgt")]
