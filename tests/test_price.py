from adega.functions.lookup import MODE_COLOURS_ARGENTINA, MODE_COLOURS_SPAIN, map_values
from adega.operators.price import unit_price_by_mode, with_unit_price
from adega.plans.reports import unit_price_report
from tests.conftest import rows

CUSTOMS = [
    ("Espanha", "Rio Grande do Sul", 48, "MARITIMA", 100.0, 500.0),
    ("Espanha", "Rio Grande do Sul", 57, "MARITIMA", 50.0, 100.0),
    ("Espanha", "Rio Grande do Sul", 58, "AEREA", 10.0, 200.0),
    ("Espanha", "Rio Grande do Sul", 59, "AEREA", 0.0, 10.0),        # zero kg: no price, not infinity
    ("Espanha", "Rio Grande do Sul", 59, "FERROVIARIA", 5.0, 5.0),   # unmapped colour
    ("Espanha", "Rio Grande do Sul", 48, None, 1.0, 1.0),            # no mode: not a group
    ("Espanha", "Bahia", 48, "AEREA", 1.0, 1000.0),                  # other state
]
SCHEMA = "country string, state string, group_code int, via string, net_kg double, fob_usd double"


def test_unit_price_and_mean_by_mode(spark):
    df = spark.createDataFrame(CUSTOMS, SCHEMA)
    priced = with_unit_price(df)
    assert rows(priced.filter("net_kg = 0"), "unit_price") == [(None,)]
    means = rows(unit_price_by_mode(df.filter("state = 'Rio Grande do Sul'")))
    assert means == [("AEREA", 20.0), ("FERROVIARIA", 1.0), ("MARITIMA", 3.5)]


def test_unit_price_report_and_colours(spark):
    df = spark.createDataFrame(CUSTOMS, SCHEMA)
    scatter, means = unit_price_report(df, "Espanha", "Rio Grande do Sul", [48, 57, 58, 59], MODE_COLOURS_SPAIN)
    assert scatter.count() == 6
    colours = dict(rows(scatter.select("via", "colour").distinct()))
    assert colours == {"MARITIMA": "navy", "AEREA": "crimson", "FERROVIARIA": None, None: None}
    assert rows(means.filter("via = 'MARITIMA'"), "label") == [("US$ 3.50",)]


def test_map_values(spark):
    df = spark.createDataFrame([("RODOVIARIA",), ("AEREA",), ("MARITIMA",), (None,)], "via string")
    assert rows(df.select(map_values("via", MODE_COLOURS_ARGENTINA))) == [("blue",), ("red",), (None,), (None,)]


def test_scan_customs_from_sheet_export_and_parquet(spark):
    import os
    import tempfile
    from adega.sources.customs import scan_customs
    folder = tempfile.mkdtemp(prefix="adega-customs-")
    csv_path = os.path.join(folder, "sheet.csv")
    with open(csv_path, "w", encoding="utf-8") as fh:
        fh.write("Países,UF do Produto,Código CUCI Grupo,Via,Quilograma Líquido,Valor US$ FOB,Extra\n")
        fh.write("Espanha,Rio Grande do Sul,48,MARITIMA,100,500,x\n")
        fh.write("Espanha,Rio Grande do Sul,n/a,AEREA,10,200,y\n")
    df = scan_customs(spark, csv_path, "csv", original_headers=True)
    assert df.columns == ["country", "state", "group_code", "via", "net_kg", "fob_usd"]
    assert rows(df) == [("Espanha", "Rio Grande do Sul", 48, "MARITIMA", 100.0, 500.0),
                        ("Espanha", "Rio Grande do Sul", None, "AEREA", 10.0, 200.0)]
    pq_path = os.path.join(folder, "customs.parquet")
    df.write.parquet(pq_path)
    assert rows(scan_customs(spark, pq_path)) == rows(df)
