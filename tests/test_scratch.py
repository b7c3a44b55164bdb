from netfell.scratch import Scratch


def test_written_table_is_read_back_and_dropped(spark):
    scratch = Scratch(spark, "test")
    back = scratch.write(spark.range(5).toDF("x"), "t")
    assert sorted(r.x for r in back.collect()) == [0, 1, 2, 3, 4]
    scratch.drop("t")
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch.path("t"))
    assert not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
