"""Report values over the committed statement CSVs (expected numbers computed
independently, see FIXTURES.md section 4)."""

from adega.operators.rank import top_countries, top_per_year
from adega.operators.totals import totals_by_country, totals_by_year_country, value_by_year_country
from adega.operators.clean import clean_statements
from adega.plans import reports as R
from adega.sources.statements import scan_lines, scan_statements
from tests.conftest import EXPORT_PRODUCTS, EXPORT_ROOT, IMPORT_PRODUCTS, IMPORT_ROOT, rows

WINES = ["foaming_wine", "table_wine"]
GRAPES = ["fresh_grapes", "grape_juice"]

R1_ARGENTINA = {  # year: (wines kg, wines US$, grapes kg, grapes US$)
    2009: (162, 4523, 415268, 936204), 2010: (None, None, 447120, 1010439),
    2011: (13253, 55460, 279051, 602517), 2012: (None, None, 173356, 332710),
    2013: (None, None, 32640, 73440), 2014: (20385, 95130, 250, 775), 2015: (None, None, 800, 5992),
    2016: (None, None, 1157638, 2350311), 2017: (None, None, 2872932, 5762915),
    2018: (20053, 76393, 1537445, 2482005), 2019: (None, None, 1190382, 1761855),
    2020: (1330, 5070, 2007924, 3715759), 2021: (6, 13, 4613639, 7776963), 2022: (480, 3232, 3955341, 8108485),
    2023: (13138, 109372, 2265833, 5237984), 2024: (31512, 259527, 3602028, 9713712),
}
R1_SPAIN = {
    2009: (2181, 4050, None, None), 2010: (None, None, 127930, 252454), 2011: (5926, 29675, 13440, 37522),
    2013: (1976355, 3771408, None, None), 2016: (None, None, 14400, 36070), 2017: (5013, 64735, 28872, 51966),
    2018: (8394, 32084, 494802, 997622), 2019: (3542, 1356, 1094483, 2089713), 2020: (57, 356, 1743131, 3842045),
    2021: (None, None, 4554938, 8685655), 2022: (None, None, 3504580, 6022297),
    2023: (225, 5024, 4222092, 7681025), 2024: (371, 4668, 5776898, 10215457),
}
# year: (R2 kg, R2 US$, R3 kg, R3 US$, R10 kg, R10 US$)
SERIES = {
    2009: (22834323, 44321929, 37860740, 80844555, 25514198, 8940988),
    2010: (26236585, 59105687, 40139568, 94909925, 1280574, 2595303),
    2011: (25472460, 56490723, 46457627, 115287702, 1214834, 3615120),
    2012: (26773734, 62234323, 54828406, 135243877, 5775376, 5521293),
    2013: (21065378, 49466691, 53256861, 135350809, 9149059, 22744845),
    2014: (15092471, 34034750, 64181030, 167048538, 2324029, 7472795),
    2015: (17905238, 34212132, 61948798, 147031039, 1198479, 2769160),
    2016: (16179629, 32565173, 62403861, 155270970, 1786549, 4434704),
    2017: (24328243, 50499985, 71085794, 177199829, 2889572, 7135607),
    2018: (22339719, 46758037, 67651764, 171571948, 3856162, 7486063),
    2019: (19571061, 36209760, 62397566, 160930512, 3152873, 5934826),
    2020: (20360641, 40054486, 78209631, 184869861, 4409717, 6078288),
    2021: (32480500, 59067527, 73964888, 189121582, 8058704, 9851942),
    2022: (18882790, 36384055, 79344215, 200460459, 7025983, 10945282),
    2023: (26858016, 62432853, 73507885, 188945253, 5538888, 8923076),
    2024: (20032836, 49359083, 81514897, 218308749, 5324465, 8751275),
}
EXPORT_TOP_VALUE = [
    ("Países Baixos", 753197194), ("Reino Unido", 431261744), ("Estados Unidos", 359175130), ("Japão", 100170258),
    ("Alemanha, República Democrática", 59130046), ("Paraguai", 52449043), ("Argentina", 50480786),
    ("Espanha", 43825182), ("Noruega", 30558272), ("Romênia", 28569808), ("Canadá", 24518083),
    ("Rússia", 23203054), ("Emirados Árabes Unidos", 19939438), ("Irlanda", 17073983), ("China", 12857595),
    ("Bélgica", 10192777), ("Suécia", 7615495), ("Uruguai", 5406242), ("Dinamarca", 4238063),
    ("Rússia,  Federação da", 4237609), ("Haiti", 3955098), ("Venezuela", 3549357), ("Finlândia", 3168273),
    ("México", 2474908), ("Angola", 2281062), ("Lituânia", 2252334), ("Itália", 2191104),
    ("Hong Kong", 1493034), ("Portugal", 1487753), ("Porto Rico", 1437360),
]
EXPORT_TOP_QUANTITY = [
    ("Países Baixos", 356413624), ("Reino Unido", 183980619), ("Estados Unidos", 140602780), ("Japão", 37875369),
    ("Paraguai", 37111757), ("Rússia", 32942702), ("Alemanha, República Democrática", 28074439),
    ("Argentina", 24651966), ("Espanha", 23577630), ("Romênia", 13194830), ("Noruega", 10997250),
    ("Canadá", 7916971), ("Emirados Árabes Unidos", 7446811), ("Irlanda", 7004943), ("China", 6459261),
    ("Bélgica", 4322441), ("Suécia", 3036151), ("Uruguai", 2883559), ("Haiti", 2825199),
    ("Rússia,  Federação da", 1979444), ("Dinamarca", 1627579), ("Bolívia", 1569299), ("Venezuela", 1313286),
    ("Portugal", 1055470), ("Finlândia", 1019737), ("Lituânia", 1011868), ("Líbia", 921348),
    ("México", 865182), ("Angola", 816854), ("Itália", 682685),
]
IMPORT_TOP_VALUE = [
    ("Chile", 2522395608), ("Argentina", 1730914495), ("Portugal", 774633116), ("França", 651394623),
    ("Itália", 591704155), ("Espanha", 325098981), ("Uruguai", 102664684), ("Estados Unidos", 54403337),
    ("Africa do Sul", 42617345), ("Peru", 39926522), ("Turquia", 29729741), ("Irã", 27371805),
    ("África do Sul", 24324151), ("Austrália", 23336606), ("Índia", 10637779), ("Alemanha", 9257919),
    ("Nova Zelândia", 9205939), ("Uzbequistão", 7086770), ("México", 4724756), ("Áustria", 2730127),
    ("Grécia", 2675904), ("Hungria", 2453784), ("China Continental", 2340218), ("Brasil", 2271709),
    ("Israel", 2096940), ("Afeganistão", 1764980), ("Líbano", 1688245), ("Coreia do Sul, República", 1225776),
    ("Emirados", 1033125), ("Eslovênia", 923204),
]
IMPORT_TOP_QUANTITY = [
    ("Chile", 1008753531), ("Argentina", 709806733), ("Portugal", 252630978), ("Itália", 185819534),
    ("Espanha", 100084908), ("França", 93245656), ("Uruguai", 38671190), ("Peru", 20125469),
    ("Turquia", 18300945), ("Irã", 13674168), ("Estados Unidos", 13023834), ("Africa do Sul", 12514173),
    ("África do Sul", 10118273), ("Índia", 9248180), ("Austrália", 6340973), ("Uzbequistão", 5365160),
    ("Alemanha", 2081152), ("México", 2012111), ("Brasil", 1691701), ("China Continental", 1510442),
    ("Nova Zelândia", 1186990), ("Coreia do Sul, República", 1116691), ("Afeganistão", 1057000),
    ("Áustria", 1013056), ("itália", 777133), ("Grécia", 680279), ("Emirados", 494260), ("Israel", 475348),
    ("China", 431015), ("Hungria", 327577),
]
EXPORT_2024_VALUE = ["Países Baixos", "Estados Unidos", "Reino Unido", "Espanha", "Argentina", "Paraguai", "Japão",
                     "Canadá", "Alemanha, República Democrática", "Noruega", "China", "Irlanda",
                     "Emirados Árabes Unidos", "Haiti", "Uruguai"]
EXPORT_2024_QUANTITY = ["Países Baixos", "Estados Unidos", "Reino Unido", "Espanha", "Paraguai", "Argentina",
                        "Japão", "Canadá", "Alemanha, República Democrática", "China", "Noruega", "Irlanda",
                        "Haiti", "Uruguai", "Emirados Árabes Unidos"]


def exports(spark):
    return scan_statements(spark, EXPORT_ROOT, EXPORT_PRODUCTS, flow="export")


def imports(spark):
    return scan_statements(spark, IMPORT_ROOT, IMPORT_PRODUCTS, flow="import")


def _r1(spark, country, expected):
    lines = scan_lines(spark, EXPORT_ROOT, EXPORT_PRODUCTS)
    for products, cols in ((WINES, (0, 1)), (GRAPES, (2, 3))):
        got = {y: (q, v) for y, q, v in rows(R.country_product_report(lines, country, products, check=True),
                                              "year", "quantity_kg", "value_usd")}
        want = {y: (e[cols[0]], e[cols[1]]) for y, e in expected.items() if e[cols[0]] is not None}
        assert got == want


def test_r1_argentina(spark):
    _r1(spark, "argentina", R1_ARGENTINA)


def test_r1_spain(spark):
    _r1(spark, "espanha", R1_SPAIN)


def test_r1_plain_split_gives_same_numbers(spark):
    lines = scan_lines(spark, EXPORT_ROOT, EXPORT_PRODUCTS)
    a = R.country_product_report(lines, "argentina", GRAPES, quote_aware=False)
    b = R.country_product_report(lines, "argentina", GRAPES)
    assert rows(a) == rows(b)


def test_r2_r3_country_series(spark):
    r2 = rows(R.country_series(exports(spark), "Países Baixos"), "year", "quantity_kg", "value_usd")
    assert r2 == [(y, float(e[0]), float(e[1])) for y, e in sorted(SERIES.items())]
    r3 = rows(R.country_series(imports(spark), "Chile"), "year", "quantity_kg", "value_usd")
    assert r3 == [(y, float(e[2]), float(e[3])) for y, e in sorted(SERIES.items())]


def test_r2_labels(spark):
    got = rows(R.country_series(exports(spark), "Países Baixos").filter("year = 2024"),
               "quantity_label", "value_label")
    assert got == [("20M Kg", "$49M")]


def test_r10_table_wine_totals(spark):
    got = rows(R.product_year_table(exports(spark), ["table_wine"]), "year", "quantity_kg", "value_usd")
    assert got == [(y, float(e[4]), float(e[5])) for y, e in sorted(SERIES.items())]
    labels = rows(R.product_year_table(exports(spark), ["table_wine"]).filter("year = 2024"),
                  "value_label", "quantity_label")
    assert labels == [("US$ 8,751,275.00", "5,324,465 Kg")]


def test_r7_r8_top30(spark):
    for frame, by_value, by_quantity, n_countries, kg, usd in (
            (exports(spark), EXPORT_TOP_VALUE, EXPORT_TOP_QUANTITY, 195, 952556554, 2087174589),
            (imports(spark), IMPORT_TOP_VALUE, IMPORT_TOP_QUANTITY, 83, 2514609333, 7008727928)):
        totals = totals_by_country(clean_statements(frame))
        assert totals.count() == n_countries
        assert rows(totals.agg({"quantity_kg": "sum", "value_usd": "sum"})) in ([(float(kg), float(usd))],
                                                                                [(float(usd), float(kg))])
        assert rows(top_countries(totals, 30, "value_usd"), "country", "value_usd") == \
            [(c, float(v)) for c, v in by_value]
        assert rows(top_countries(totals, 30, "quantity_kg"), "country", "quantity_kg") == \
            [(c, float(v)) for c, v in by_quantity]


def test_r4_annual_top15_2024(spark):
    yearly = totals_by_year_country(clean_statements(exports(spark)))
    assert yearly.count() == 1345
    by_value = top_per_year(yearly, "value_usd", 15).filter("year = 2024").orderBy("rank")
    assert [r[0] for r in by_value.select("country").collect()] == EXPORT_2024_VALUE
    by_qty = top_per_year(yearly, "quantity_kg", 15).filter("year = 2024").orderBy("rank")
    assert [r[0] for r in by_qty.select("country").collect()] == EXPORT_2024_QUANTITY
    assert rows(by_value.limit(1), "value_usd") == [(49359083.0,)]


def test_group_counts_with_and_without_missing(spark):
    exp = value_by_year_country(clean_statements(exports(spark), missing="keep", totals=True))
    assert exp.count() == 3360
    imp_keep = value_by_year_country(clean_statements(imports(spark), missing="keep", totals=True))
    assert imp_keep.count() == 1504
    assert totals_by_year_country(clean_statements(imports(spark))).count() == 641


def test_r5_r6_top10_series_is_top10_by_value(spark):
    for frame, top in ((exports(spark), EXPORT_TOP_VALUE), (imports(spark), IMPORT_TOP_VALUE)):
        series = R.top_country_value_series(frame, 10)
        assert sorted(r[0] for r in series.select("country").distinct().collect()) == sorted(c for c, _ in top[:10])


def test_r9_table_wine_2024_ranking(spark):
    ranked, mean = R.year_ranking(exports(spark), 2024, "table_wine")
    assert ranked.count() == 74
    assert rows(ranked.orderBy("rank").limit(3), "country", "value_usd") == \
        [("Paraguai", 5121857.0), ("Haiti", 713158.0), ("Estados Unidos", 648724.0)]
    assert round(rows(mean)[0][0], 4) == 118260.4730


def test_b1_summary_and_b2_last_years(spark):
    summary = R.export_summary(exports(spark))
    assert rows(summary.filter("destination = 'Países Baixos'"), "origin", "litres", "value_usd") == \
        [("Brasil", 356413624.0, 753197194.0)]
    recent = R.last_n_years(exports(spark), 1)
    want = (20032836.0, 49359083.0)
    assert rows(recent.filter("country = 'Países Baixos'"), "quantity_kg", "value_usd") == [want]
