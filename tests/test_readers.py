"""Readers and writers over small files, and the operators that no table provides data for."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.config import Diversity
from textloom.operators import corpus, expand, mmr, ontology
from textloom.plans import models, queries, summarize
from textloom.sources import readers
from textloom.streaming.rescore import summarize_stream


def put(tmp_path, name, text):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def rows(df, *names):
    return sorted((tuple(r) for r in (df.select(*names) if names else df).collect()), key=repr)


def test_input_sets(spark, tmp_path):
    put(tmp_path, "test/questions.txt", "1||what helps?||x\n2||who||else||y||z\n3||alone||q\n")
    put(tmp_path, "test/answers.csv", 'q,a,t\n1.0,1_A1,"Rest - Now [1] <b>sleep</b>"\n1.0,1_A2,"line\nbreak ""quoted"""\n2.0,2_A1,b\n')
    put(tmp_path, "test/abstractive.txt", "1||in short||x\n")
    put(tmp_path, "test/extractive.txt", "2||part||x\n")
    got = readers.load_inputs(spark, "test", str(tmp_path), str(tmp_path / "kept"))
    want = [("1", "1_A1", "what helps?", "Rest. Now   sleep ", "in short", None), ("1", "1_A2", "what helps?", 'linebreak "quoted"', "in short", None), ("2", "2_A1", "who else y", "b", None, "part")]
    assert rows(got, "question_id", "answer_id", "question", "article", "multi_abs_summ", "multi_ext_summ") == want
    put(tmp_path, "test/questions.txt", "1||changed||x\n")
    assert rows(readers.load_inputs(spark, "test", str(tmp_path), str(tmp_path / "kept")), "question_id", "answer_id", "question", "article", "multi_abs_summ", "multi_ext_summ") == want
    with pytest.raises(ValueError):
        readers.load_inputs(spark, "other", str(tmp_path))


def test_nested_questions(spark, tmp_path):
    answer = lambda t: {"article": t, "section": "s", "url": "u", "rating": "3"}
    data = {"7": {"question": "how?", "answers": {"7_Answer2": answer("Second. Is it? yes."), "7_Answer1": answer("First one.")}, "multi_abs_summ": "m"}, "12": {"question": "none", "answers": {}}}
    nested = readers.read_nested(spark, put(tmp_path, "in.json", json.dumps(data)))
    questions, answers, sentences = readers.tables(nested)
    assert rows(questions, "question_id", "ques_pos", "multi_abs_summ") == [("12", 12, None), ("7", 7, "m")]
    assert rows(answers.where("answer_id IS NOT NULL"), "answer_id", "ans_pos", "rating") == [("7_Answer1", 71, "3"), ("7_Answer2", 72, "3")]
    assert rows(sentences, "answer_pos", "sentence_id", "sentence") == [(71, 1, "First one."), (72, 1, "Second."), (72, 2, "yes.")]
    readers.write_nested(questions, str(tmp_path / "out"))
    assert [r.question_id for r in spark.read.json(str(tmp_path / "out")).collect()] == ["12", "7"]


def test_descriptors_and_trees(spark, tmp_path):
    concept = "<Concept><ScopeNote> Note{0}\n</ScopeNote><TermList><Term><String>T{0}</String></Term><Term><String>same</String></Term></TermList></Concept>"
    record = f"<DescriptorRecord><DescriptorUI>D1</DescriptorUI><TreeNumberList><TreeNumber>C01.1</TreeNumber><TreeNumber>C02</TreeNumber></TreeNumberList><ConceptList>{concept.format(1)}{concept.format(2)}</ConceptList></DescriptorRecord>"
    path = put(tmp_path, "d.xml", f"<Set>{record}<DescriptorRecord><DescriptorUI>D2</DescriptorUI></DescriptorRecord></Set>")
    got = readers.read_descriptors(spark, path)
    assert rows(got, "node_id", "define", "terms", "tree_numbers") == [("D1", "Note1 Note2", ["T1", "same", "T2"], ["C01.1", "C02"]), ("D2", "", [], [])]
    assert rows(ontology.describe(got, "D1"), "define") == [("Note1 Note2",)]
    assert rows(readers.read_tree(spark, put(tmp_path, "t.bin", "Name;C01\nOther;C01.5\nbad\n"))) == [("Name", "C01"), ("Other", "C01.5")]


def test_class_tables(spark, tmp_path):
    head = "Class ID,Preferred Label,Synonyms,Definitions,Parents,xref\n"
    body = 'http://x/SYMP_1,Pain,ache|pain|ache,"a long, quoted one",http://x/SYMP_2|http://x/SYMP_3,MESH:D1|OMIM:5\nhttp://x/SYMP_2,Sign,,short,,\n'
    got = readers.read_class_table(spark, put(tmp_path, "c.csv", head + body), xref="xref")
    assert rows(got, "node_id", "terms", "define", "parents", "xrefs") == [("1", ["Pain", "ache", "pain"], "a long, quoted one", ["2", "3"], ["MESH:D1", "OMIM:5"]), ("2", ["Sign"], None, [], [])]
    with pytest.raises(ValueError):
        readers.read_class_table(spark, put(tmp_path, "twice.csv", head + body + body))


def test_relations_and_genes(spark, tmp_path):
    path = put(tmp_path, "cd.csv", "ChemicalID,DiseaseID,DirectEvidence,InferenceScore\nC1,MESH:D1,therapeutic,\nC2,OMIM:2,,3.5\n")
    assert rows(readers.read_chemical_diseases(spark, path)) == [("C1", "MESH:D1", "therapeutic", None), ("C2", "OMIM:2", None, 3.5)]
    assert rows(readers.read_gene_lists(spark, put(tmp_path, "g.json", json.dumps({"MESH:D1": ["g1", "g2"], "OMIM:2": []})))) == [("MESH:D1", "g1"), ("MESH:D1", "g2")]
    table = put(tmp_path, "g.csv", "# made\n#\nGene,Id,Disease\ng1,1,D1\ng1,1,D1\ng2,2,\n")
    assert rows(readers.read_gene_table(spark, table, ("Gene", "Id", "Disease"), "Gene", "Disease")) == [("D1", "g1")]


def test_embedding_store(spark, tmp_path):
    path, asked = str(tmp_path / "store"), []

    def embed(df):
        asked.append(rows(df))
        return df.select("text", F.array(F.length("text").cast("double")).alias("vec"))

    texts = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    readers.update_embeddings(spark, path, texts("a", "bb", "a", None), embed)
    store = readers.update_embeddings(spark, path, texts("bb", "ccc"), embed)
    assert asked == [[("a",), ("bb",)], [("ccc",)]] and rows(store) == [("a", [1.0]), ("bb", [2.0]), ("ccc", [3.0])]
    assert rows(readers.with_embeddings(texts("a", "no"), store, 1)) == [("a", [1.0]), ("no", [0.0])]
    readers.write_text_ids(store, str(tmp_path / "ids"))
    ids = spark.read.parquet(str(tmp_path / "ids")).collect()
    assert {r.text for r in ids} == {"a", "bb", "ccc"} and len({r.id for r in ids}) == 3


def test_nodes(spark):
    nodes = spark.createDataFrame([("A", ["Heart-Attack", "heartattack"], "The 2 sharp pains, severe.", [])], "node_id string, terms array<string>, define string, tree_numbers array<string>")
    got = ontology.normalize_nodes(nodes).first()
    assert got.terms == ["heartattack", "heartattack"] and got.define_tokens == ["2", "sharp", "pains", "severe"] and got.define_ners == ["sharp pains", "pains severe"]
    symptoms = spark.createDataFrame([("S1", ["sharp pain", "ache"]), ("S2", ["fever"])], "node_id string, terms array<string>")
    assert rows(expand.annotate_symptoms(ontology.normalize_nodes(nodes), symptoms)) == [("A", "ache"), ("A", "sharp pain")]
    edge = lambda *e: spark.createDataFrame(e, "parent_id string, child_id string")
    links = spark.createDataFrame([("m2", "B")], "node_id string, base_id string")
    assert rows(ontology.merged_edges(edge(("A", "B")), edge(("m1", "m2"), ("m2", "m3"), ("m3", "m4")), links)) == [("A", "B"), ("B", "m3"), ("m1", "B"), ("m3", "m4")]


def test_word_forms(spark):
    t = lambda s, *r: spark.createDataFrame(r, s)
    words, forms, derived = t("word string, lemma string", ("care", "care"), ("carer", "carer")), t("word string, form string", ("care", "cares"), ("carer", "carers")), t("word string, other string", ("care", "carer"))
    assert rows(expand.word_forms(words, forms, derived)) == [("care", "care"), ("care", "carer"), ("care", "carers"), ("care", "cares"), ("carer", "carer"), ("carer", "carers")]
    assert rows(expand.word_forms(words, forms, derived, False)) == [("care", "care"), ("care", "carer"), ("carer", "carer")]


def test_share_of_sentences(spark):
    frame = spark.createDataFrame([(1, i, i, f"t{i}", [float(i), 1.0], [1.0, 1.0]) for i in range(10)], "question_id long, item long, pos long, text string, vec array<double>, query_vec array<double>")
    assert mmr.mmr(frame, Diversity(0.85, 0.35, 2.0)).count() == 3


def test_models(spark, small_dir):
    made = models.Corpus(*summarize.prepared(spark, spark.read.parquet(f"{small_dir}/conversations.parquet")))
    fitted = models.models()["query"].fit(spark, made)
    row = queries.queries()["query_similarity"](spark, small_dir).first()
    assert fitted.score_of(row.question_id, row.answer_id, row.sentence_id) == pytest.approx(row.score, abs=1e-6) and fitted.score_of(-1, 0, 0) is None
    assert set(models.models()) == {"tfidf", "lexrank", "keyword", "mover", "query"}


def test_stream(spark, small_dir, tmp_path):
    """A micro-batch gives what the batch operator gives."""
    table = spark.read.parquet(f"{small_dir}/conversations.parquet")
    table.write.parquet(str(tmp_path / "in"))
    got, questions = [], lambda df: corpus.questions(df)
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    summarize_stream(stream, questions, lambda df, n: got.extend(rows(df)), str(tmp_path / "state")).processAllAvailable()
    for q in spark.streams.active:
        q.stop()
    assert sorted(got, key=repr) == rows(questions(table))
