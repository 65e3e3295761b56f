"""Literature XML, files by their ending, manifests."""

import gzip
import json

import pytest

from litmill.sources import articles, files

XML = """<?xml version="1.0"?><Set>
<PubmedArticle><MedlineCitation Status="MEDLINE" Owner="NLM"><PMID Version="1">7</PMID><DateRevised><Year>2021</Year><Month>02</Month><Day>3</Day></DateRevised>
 <Article><Journal><ISSN>1234-5678</ISSN><JournalIssue><Volume>5</Volume><PubDate><MedlineDate>2019 Nov-Dec</MedlineDate></PubDate></JournalIssue><Title> J </Title></Journal><ArticleTitle>T</ArticleTitle>
 <ELocationID EIdType="pii" ValidYN="Y">S1</ELocationID><ELocationID EIdType="doi" ValidYN="Y">10.1/E</ELocationID>
 <Abstract><AbstractText Label="AIM">A.</AbstractText><AbstractText NlmCategory="RESULTS">B.</AbstractText><AbstractText>C.</AbstractText><AbstractText> </AbstractText></Abstract>
 <AuthorList><Author><LastName>Doe</LastName><ForeName>Ann</ForeName><AffiliationInfo><Affiliation>U1</Affiliation></AffiliationInfo><AffiliationInfo><Affiliation>U2</Affiliation></AffiliationInfo></Author>
  <Author><LastName>Roe</LastName><Initials>B</Initials></Author><Author><CollectiveName>Group</CollectiveName></Author></AuthorList><Language>eng</Language>
 <GrantList><Grant><GrantID>G1</GrantID><Agency>NIH</Agency><Country>US</Country></Grant></GrantList><PublicationTypeList><PublicationType UI="D1">Review</PublicationType></PublicationTypeList></Article>
 <ChemicalList><Chemical><RegistryNumber>0</RegistryNumber><NameOfSubstance UI="D2">Water</NameOfSubstance></Chemical></ChemicalList>
 <MeshHeadingList><MeshHeading><DescriptorName UI="D3" MajorTopicYN="N">Cells</DescriptorName><QualifierName UI="Q1" MajorTopicYN="Y">physiology</QualifierName></MeshHeading></MeshHeadingList>
 <KeywordList Owner="NOTNLM"><Keyword>k1</Keyword><Keyword> </Keyword><Keyword>k2</Keyword></KeywordList></MedlineCitation>
 <PubmedData><History><PubMedPubDate PubStatus="entrez"><Year>2019</Year><Month>1</Month><Day>1</Day></PubMedPubDate><PubMedPubDate PubStatus="received"><Year>2018</Year><Month>May</Month><Day>6</Day><Hour>7</Hour><Minute>5</Minute></PubMedPubDate></History>
 <ArticleIdList><ArticleId IdType="pubmed">7</ArticleId></ArticleIdList>
 <ReferenceList><Reference><Citation>Old work.</Citation></Reference><Reference><Citation>x</Citation><ArticleIdList><ArticleId IdType="pubmed">8</ArticleId></ArticleIdList></Reference>
  <Reference><ArticleIdList><ArticleId IdType="doi">10.1/r</ArticleId></ArticleIdList></Reference><Reference><ArticleIdList><ArticleId IdType="pubmed">99</ArticleId></ArticleIdList></Reference></ReferenceList></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>8</PMID><Article><Journal><JournalIssue><PubDate><Year>2020</Year><Month>Sep</Month></PubDate></JournalIssue></Journal></Article></MedlineCitation>
 <PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/own</ArticleId></ArticleIdList></PubmedData></PubmedArticle></Set>"""


def test_articles(spark, tmp_path):
    with gzip.open(tmp_path / "a.xml.gz", "wt") as f:
        f.write(XML)
    df = articles.read_articles(spark, str(tmp_path / "a.xml.gz"))
    a, b = df.orderBy("pubmed_id").collect()
    assert (a.pubmed_id, a.doi, a.title, a.venue, a.language, a.year, a.published_at, a.submitted_at, a.updated_at) == ("7", "10.1/E", "T", "J", "eng", 2019, "2019", "2018-05-06", "2021-02-03")
    assert a.abstract == "AIM: A.\nRESULTS: B.\nC." and [x.name for x in a.authors] == ["Ann Doe", "Roe B", "Group"] and a.authors[0].affiliations == ["U1", "U2"]
    assert a.history[1].time == "07:05" and a.keyword_lists[0].keywords == ["k1", "k2"] and a.headings[0].qualifiers[0].name == "physiology" and a.headings[0].descriptor.ui == "D3"
    assert a.chemicals[0].name == "Water" and a.grants[0].Agency == "NIH" and a.publication_types[0].name == "Review" and a.journal.issn == "1234-5678"
    assert (b.doi, b.published_at, b.title, b.authors, b.submitted_at) == ("10.1/own", "2020-09", None, None, None)
    known = spark.createDataFrame([("8", "W8"), ("8", "W8")], "pubmed_id string, work_id string")
    assert [r.cited for r in articles.citation_edges(df, known).orderBy("position").collect()] == ["CITATION:Old work.", "W8", "DOI:10.1/r", "PMID:99"]
    assert sorted(r.articles for r in articles.write_batches(df.repartition(1), str(tmp_path / "out"), 1).collect()) == [1, 1]


def test_records_by_ending(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('\n{"a": 1}\n{bad\n{"a": 3}\n')
    (tmp_path / "b.json").write_text(json.dumps({"a": 5}, indent=1))
    got = {(r.file[-6:], r.line_number, r.record.a if r.record else None, r.error) for r in files.read_records(spark, str(tmp_path), "a int").collect()}
    assert got == {(".jsonl", 2, 1, None), (".jsonl", 3, None, "line is no JSON"), (".jsonl", 4, 3, None), ("b.json", 1, 5, None)}
    assert files.read_records(spark, str(tmp_path / "b.json"), "a int").first().record.a == 5
    with pytest.raises(ValueError, match="no reader"):
        files.read_records(spark, str(tmp_path / "c.csv"), "a int")
    lines = files.read_json_lines(spark, str(tmp_path))
    assert [r.value for r in files.line(lines, 3).collect()] == ['{"a": 3}'] and [r.line_number for r in files.line(lines).collect()] == [2]


def test_manifest(spark, tmp_path):
    m = files.Manifest(spark, str(tmp_path))
    assert m.totals() == {"shards": 0, "rows": 0, "max_id": None}
    m.add(spark.createDataFrame([(0, 10, "p0"), (1, 20, "p1")], "shard int, n_rows bigint, path string"))
    m.update(spark.createDataFrame([(1, 25, False), (7, 1, True)], "shard int, n_rows bigint, writable boolean"))
    assert {(r.shard, r.n_rows, r.path, r.writable) for r in m.shards().collect()} == {(0, 10, "p0", None), (1, 25, "p1", False)} and m.totals()["rows"] == 35
    with pytest.raises(ValueError, match="already"):
        m.add(spark.createDataFrame([(1, 1)], "shard int, n_rows bigint"))


def test_lines_of_split_files(spark, tmp_path):
    """Lines keep their numbers where a file is read in many splits."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        (tmp_path / "a.jsonl").write_text("".join(f'{{"a": {i}}}\n' + "\n" * (i % 3) for i in range(200)))
        (tmp_path / "b.jsonl").write_text("".join(f'{{"a": {i}}}\n' for i in range(50)))
        lines = files.read_json_lines(spark, str(tmp_path))
        got = {(r.file[-7:], r.line_number, json.loads(r.value)["a"]) for r in lines.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want, n = set(), 1
    for i in range(200):
        want.add(("a.jsonl", n, i))
        n += 1 + i % 3
    assert got == want | {("b.jsonl", i + 1, i) for i in range(50)}
