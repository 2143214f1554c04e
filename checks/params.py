"""Parameters shared by the registered queries and their SQL."""

START, END = "2024-01-03", "2024-01-28"
MODEL = "D1"
GAP_DAY = "2024-02-02"  # later than all data
AS_OF_USERS = "2001-08-01"
AS_OF_DEVICES = "2024-01-30"
FROM_DAY, TO_DAY = "1996-03-01", "1999-10-15"
USER_QUERY_COUNTRIES = ["NATION_1", "NATION_2", "NATION_3", "NATION_7"]
USER_QUERY_SOURCES = ["EC", "AP"]
FIRMWARE_VERSIONS = ["0", "1", "2", "3", "4", "5", "6"]
