from pyspark.sql import functions as F

from histospark.llm import imageref


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_references(spark):
    refs = ["IMG-0001224", "1063.tif", "IMG1166_v2.png", " 42 ", "#７", "image no. 12", "none", None]
    assert column(spark, refs, imageref.image_number) == [1224, 1063, 1166, 42, 7, 12, None, None]
    patients = ["PT_0000010", "pat. no. 0000019", " #22 ", "Pt.5", "P-000003", "PT-０００３", "pt7", "Patient 8", "0", "n.n.", "-", "", None]
    assert column(spark, patients, imageref.patient_number) == [10, 19, 22, 5, 3, 3, 7, 8, None, None, None, None, None]
