"""Reference tables that are seeded: their keys and years."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values: (id, act, section, year of the amendment).
AMENDMENTS = [
    ("AMEND_001", "Indian Penal Code 1860", "375", 2013),
    ("AMEND_002", "Indian Penal Code 1860", "376", 2013),
    ("AMEND_003", "Indian Penal Code 1860", "354", 2013),
    ("AMEND_004", "Information Technology Act 2000", "66A", 2015),
    ("AMEND_005", "Indian Penal Code 1860", "All", 2023),
    ("AMEND_006", "Code of Criminal Procedure 1973", "All", 2023),
    ("AMEND_007", "Indian Evidence Act 1872", "All", 2023),
    ("AMEND_008", "Negotiable Instruments Act 1881", "138", 2018),
    ("AMEND_009", "Negotiable Instruments Act 1881", "143A", 2018),
    ("AMEND_010", "Negotiable Instruments Act 1881", "142", 2015),
    ("AMEND_011", "Protection of Children from Sexual Offences Act 2012", "4", 2019),
    ("AMEND_012", "Protection of Children from Sexual Offences Act 2012", "9", 2019),
    ("AMEND_013", "Scheduled Castes and Scheduled Tribes Prevention of Atrocities Act 1989", "18", 2018),
    ("AMEND_014", "Arbitration and Conciliation Act 1996", "29A", 2015),
    ("AMEND_015", "Arbitration and Conciliation Act 1996", "36", 2015),
    ("AMEND_016", "Arbitration and Conciliation Act 1996", "87", 2019),
    ("AMEND_017", "Consumer Protection Act 1986", "All", 2019),
    ("AMEND_018", "Companies Act 2013", "Various", 2019),
    ("AMEND_019", "Companies Act 2013", "135", 2020),
    ("AMEND_020", "Hindu Marriage Act 1955", "13B", 2001),
    ("AMEND_021", "Hindu Marriage Act 1955", "5", 1976),
    ("AMEND_022", "Code of Civil Procedure 1908", "89", 2002),
    ("AMEND_023", "Code of Civil Procedure 1908", "Order 7 Rule 11", 2002),
    ("AMEND_024", "Code of Civil Procedure 1908", "Order 6 Rule 15A", 2002),
    ("AMEND_025", "Transfer of Property Act 1882", "54", 2001),
    ("AMEND_026", "Protection of Women from Domestic Violence Act 2005", "12", 2010),
    ("AMEND_027", "Limitation Act 1963", "5", 2002),
    ("AMEND_028", "Specific Relief Act 1963", "10", 2018),
    ("AMEND_029", "Specific Relief Act 1963", "14", 2018),
    ("AMEND_030", "Specific Relief Act 1963", "20", 2018),
    ("AMEND_031", "Income Tax Act 1961", "194J", 2012),
    ("AMEND_032", "Indian Contract Act 1872", "10A", 2013),
    ("AMEND_033", "Indian Penal Code 1860", "377", 2018),
    ("AMEND_034", "Indian Penal Code 1860", "497", 2018),
    ("AMEND_035", "Indian Penal Code 1860", "309", 1994),
    ("AMEND_036", "Motor Vehicles Act 1988", "Various", 2019),
    ("AMEND_037", "Right to Information Act 2005", "Various", 2019),
    ("AMEND_038", "Prevention of Corruption Act 1988", "Various", 2018),
    ("AMEND_039", "Benami Transactions Prohibition Act 1988", "All", 2016),
    ("AMEND_040", "Insolvency and Bankruptcy Code 2016", "29A", 2017),
    ("AMEND_041", "Insolvency and Bankruptcy Code 2016", "12A", 2019),
    ("AMEND_042", "Trade Marks Act 1999", "Various", 2010),
    ("AMEND_043", "Geographical Indications of Goods Act 1999", "Various", 2013),
    ("AMEND_044", "Patents Act 1970", "3(d)", 2005),
    ("AMEND_045", "Patents Act 1970", "84", 2005),
    ("AMEND_046", "Copyright Act 1957", "52", 2012),
    ("AMEND_047", "Copyright Act 1957", "18", 2012),
    ("AMEND_048", "Enemy Property Act 1968", "Various", 2017),
    ("AMEND_049", "Aadhaar Act 2016", "Various", 2019),
    ("AMEND_050", "Personal Data Protection Bill 2019", "All", 2023),
]

# Fixed values: (id, overruled citation, citation that overruled it, year).
OVERRULINGS = [
    ("OVER_001", "AIR 1950 SC 27", "AIR 1978 SC 597", 1978),
    ("OVER_002", "AIR 1976 SC 1207", "(2017) 10 SCC 1", 2017),
    ("OVER_003", "(2014) 1 SCC 1", "(2018) 10 SCC 1", 2018),
    ("OVER_004", "AIR 1980 SC 1789", "AIR 1980 SC 1789", 1980),
    ("OVER_005", "AIR 1991 SC 207", "AIR 1996 SC 1393", 1996),
    ("OVER_006", "AIR 1994 SC 1349", "AIR 1997 SC 610", 1997),
    ("OVER_007", "AIR 1980 SC 898", "AIR 1983 SC 957", 1983),
    ("OVER_008", "AIR 2007 SC 1274", "(2014) 8 SCC 273", 2014),
    ("OVER_009", "AIR 1979 SC 1360", "AIR 1979 SC 1377", 1979),
    ("OVER_010", "AIR 1999 SC 3762", "(2014) 9 SCC 129", 2014),
    ("OVER_011", "(2007) 6 SCC 555", "(2018) 1 SCC 560", 2018),
    ("OVER_012", "AIR 1960 SC 1125", "Various", 1990),
    ("OVER_013", "(2014) 10 SCC 473", "(2020) 7 SCC 1", 2020),
    ("OVER_014", "(2002) 8 SCC 766", "Act No. 28 of 2018", 2018),
    ("OVER_015", "(2005) 4 SCC 741", "(2021) 2 SCC 1", 2021),
    ("OVER_016", "AIR 1910 PC 111", "AIR 1987 SC 2253", 1987),
    ("OVER_017", "(2004) 4 SCC 657", "(2016) 10 SCC 165", 2016),
    ("OVER_018", "AIR 2001 SC 3958", "(2010) 1 SCC 666", 2010),
    ("OVER_019", "(1993) 4 SCC 727", "(2006) 4 SCC 1", 2006),
    ("OVER_020", "AIR 1985 SC 1281", "(2012) 6 SCC 613", 2012),
    ("OVER_021", "AIR 1997 SC 645", "(2012) 11 SCC 565", 2012),
    ("OVER_022", "(2008) 11 SCC 99", "(2017) 8 SCC 781", 2017),
    ("OVER_023", "AIR 1970 SC 2015", "Various", 1995),
    ("OVER_024", "(1997) 1 SCC 388", "(2011) 8 SCC 161", 2011),
    ("OVER_025", "AIR 1952 SC 64", "Various", 1975),
    ("OVER_026", "Pre-2013", "Act No. 30 of 2013", 2013),
    ("OVER_027", "Pre-2005", "Act No. 39 of 2005", 2005),
    ("OVER_028", "AIR 1969 SC 33", "AIR 1980 SC 1535", 1980),
    ("OVER_029", "(2007) 3 SCC 184", "AIR 1993 SC 412", 1993),
    ("OVER_030", "Pre-1995", "Act No. 27 of 1995", 1995),
]


def tables(spark: SparkSession) -> DataFrame:
    """Rows of (collection, id, name, reference, year): an amendment's act and section, or an overruled and an overruling citation."""
    rows = [("amendments", *r) for r in AMENDMENTS] + [("overruling_map", *r) for r in OVERRULINGS]
    return spark.createDataFrame(rows, "collection string, id string, name string, reference string, year int")
