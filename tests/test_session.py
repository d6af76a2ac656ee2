from panelyard.session import METHOD_BYTES, compiled_methods


def test_methods_stay_within_what_the_jvm_compiles(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "65535")
        compiled_methods(spark)
        assert int(spark.conf.get(name)) == METHOD_BYTES
        spark.conf.set(name, "500")
        compiled_methods(spark)
        assert spark.conf.get(name) == "500"  # a tighter limit of the session stays
    finally:
        spark.conf.set(name, before)
