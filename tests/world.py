"""A four-customer world with hand-computed marts."""

APPLICATION = (
    "SK_ID_CURR bigint, TARGET bigint, NAME_CONTRACT_TYPE string, CODE_GENDER string, FLAG_OWN_CAR string, "
    "AMT_INCOME_TOTAL double, AMT_CREDIT double, AMT_ANNUITY double, AMT_GOODS_PRICE double, CNT_FAM_MEMBERS double, "
    "DAYS_BIRTH bigint, DAYS_EMPLOYED bigint, OWN_CAR_AGE double, EXT_SOURCE_1 double, EXT_SOURCE_2 double, EXT_SOURCE_3 double"
)
APPLICATION_ROWS = [
    (100001, 0, "Cash", "F", "N", 100.0, 200.0, 10.0, 180.0, 2.0, -10000, -1000, None, 0.1, 0.2, None),
    (100002, 1, "Cash", "M", "Y", 200.0, 100.0, 20.0, 90.0, 1.0, -12000, 365243, None, None, None, None),
    (100003, 0, "Revolving", "F", "Y", 0.0, 50.0, 0.0, 0.0, 0.0, -9000, -500, 5.0, 0.3, 0.3, 0.3),
    (100004, 1, "Cash", "M", "N", 50.0, 75.0, 5.0, 70.0, 1.0, -8000, -100, None, None, 0.4, 0.6),
]
SPLITS = "SK_ID_CURR bigint, TARGET bigint, SPLIT string"
SPLIT_ROWS = [(100001, 0, "train"), (100002, 1, "validation"), (100003, 0, "test"), (100004, 1, "train")]

BUREAU = (
    "SK_ID_CURR bigint, SK_ID_BUREAU bigint, CREDIT_ACTIVE string, CREDIT_CURRENCY string, CREDIT_TYPE string, "
    "DAYS_CREDIT bigint, CREDIT_DAY_OVERDUE bigint, AMT_CREDIT_MAX_OVERDUE double, CNT_CREDIT_PROLONG bigint, "
    "AMT_CREDIT_SUM double, AMT_CREDIT_SUM_DEBT double, AMT_CREDIT_SUM_OVERDUE double, DAYS_CREDIT_UPDATE bigint, AMT_ANNUITY double"
)
BUREAU_ROWS = [
    (100001, 1, "Active", "currency 1", "Consumer", -100, 5, 20.0, 1, 1000.0, 200.0, 10.0, -10, 50.0),
    (100001, 2, "Closed", "currency 1", "Card", -500, 0, None, 0, 500.0, None, 0.0, -300, None),
    (100002, 3, "Active", "currency 2", "Consumer", -50, 0, None, 0, 900.0, 100.0, 0.0, -5, 10.0),
    (100004, 4, "Active", "currency 1", "Consumer", -20, 0, None, 0, 300.0, 30.0, 0.0, 3, 10.0),
    (999999, 5, "Active", "currency 1", "Consumer", -20, 0, None, 0, 300.0, 30.0, 0.0, -3, 10.0),
]
PAYMENTS = (
    "SK_ID_PREV bigint, SK_ID_CURR bigint, NUM_INSTALMENT_VERSION double, NUM_INSTALMENT_NUMBER bigint, "
    "DAYS_INSTALMENT double, DAYS_ENTRY_PAYMENT double, AMT_INSTALMENT double, AMT_PAYMENT double"
)
PAYMENT_ROWS = [
    (11, 100001, 1.0, 1, -100.0, -95.0, 100.0, 40.0),
    (11, 100001, 1.0, 1, -100.0, -90.0, 100.0, 60.0),
    (11, 100001, 1.0, 2, -60.0, None, 100.0, None),
    (12, 100002, 1.0, 1, -800.0, -805.0, 50.0, 0.0),
    (13, 100003, 1.0, 1, -400.0, -401.0, 100.0, 120.0),
    (99, 999999, 1.0, 1, -10.0, -10.0, 10.0, 10.0),
]


def tables(spark):
    make = spark.createDataFrame
    return (
        make(APPLICATION_ROWS, APPLICATION),
        make(SPLIT_ROWS, SPLITS),
        make(BUREAU_ROWS, BUREAU),
        make(PAYMENT_ROWS, PAYMENTS),
    )
