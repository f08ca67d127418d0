from pyspark.sql import functions as F

from kelpforge.operators import metadata as M

CASES = [
    ("a.txt", "Código: POP-QA-012\nRevisão: 3\nSituação: Vigente\nTítulo: Limpeza\nÁrea: Qualidade\n", ("POP-QA-012", "POP", "Limpeza", "03", "vigent", "Qualidade", [])),
    ("b.txt", "Documento\n\nIT–LOG.7\nRevisão\n1.2\nrascunho", ("IT-LOG.7", "IT", None, "1.2", "draft", None, [])),
    ("FOR-PR-0034 rev2.txt", "uma linha sem nada", ("FOR-PR-0034", "Form", None, "02", None, None, [])),
    ("c.txt", "Veja POP-QA-001 e IT-QA-002.\nversão 4", (None, None, None, "04", None, None, ["missing_document_code", "ambiguous_nested_document_codes"])),
    ("d.txt", "Protocolo\nPTC.ABC.DEF.012 de uso\nSumário\nABC 1", ("PTC.ABC.DEF.012", "PTC", None, None, None, None, ["missing_revision"])),
    ("e.txt", "InstruÃ§Ã£o de trabalho\nstatus: obsoleto", (None, "IT", None, None, "obsolete", None, ["missing_document_code", "missing_revision"])),
    ("f.txt", "code:\nABC123\ncodigo: nada\nSPEC 77\nversion: x", ("ABC123", None, None, None, None, None, ["missing_revision"])),
    (None, None, (None, None, None, None, None, None, ["missing_document_code", "missing_revision"])),
    ("g.txt", "", (None, None, None, None, None, None, ["missing_document_code", "missing_revision"])),
]


def test_metadata(spark):
    rows = [(k, name, text) for k, (name, text, _) in enumerate(CASES)]
    got = {r.doc_id: r for r in M.metadata(spark.createDataFrame(rows, "doc_id long, filename string, text string")).collect()}
    for k, (_, text, want) in enumerate(CASES):
        r = got[k]
        assert (r.document_code, r.document_type, r.title, r.revision, r.status, r.owner_area, r.gap_codes) == want, text


def test_forms(spark):
    row = spark.range(1).select(M.label(F.lit("  Nº da  Versão: ")).alias("a"), M.code_form(F.lit(" pop - qa . 12 .")).alias("b"), M.revision_form(F.lit(" 7 ")).alias("c"), M.revision_form(F.lit("1.2")).alias("d")).first()
    assert tuple(row) == ("n da versao", "POP-QA.12", "07", "1.2")
