"""The nine tables: schemas, keys, defaults and declared rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

LONG, INT, TEXT = T.LongType(), T.IntegerType(), T.StringType()
TIME, PRICE, MONEY = T.TimestampNTZType(), T.DecimalType(10, 2), T.DecimalType(12, 2)
TOTAL = T.DecimalType(28, 2)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SCHEMAS: dict[str, T.StructType] = {
    "users": _schema(UserID=LONG, Username=TEXT, Email=TEXT, Role=TEXT, Is_Active=INT, Created_At=TIME),
    "category": _schema(CategoryID=LONG, Name=TEXT, Description=TEXT, IS_ACTIVE=INT, Created_At=TIME),
    "suppliers": _schema(
        SupplierID=LONG, Name=TEXT, Contact=TEXT, Email=TEXT, Address=TEXT, Is_Active=INT, Created_At=TIME
    ),
    "products": _schema(
        ProductID=LONG, Name=TEXT, CategoryID=LONG, SupplierID=LONG, Unit_Price=PRICE, Is_Active=INT,
        Created_At=TIME,
    ),
    "stock_management": _schema(
        StockID=LONG, ProductID=LONG, Quantity=LONG, Restock_Level=LONG, Last_Updated=TIME
    ),
    "transactions": _schema(
        TransactionID=LONG, UserID=LONG, Trans_Type=TEXT, Trans_Date=TIME, Total_Amount=MONEY, Notes=TEXT
    ),
    "transaction_items": _schema(
        ItemID=LONG, TransactionID=LONG, ProductID=LONG, Quantity=LONG, Unit_Price=PRICE, Subtotal=MONEY
    ),
    "reports": _schema(
        ReportID=LONG, Report_Type=TEXT, Generated_By=LONG, Generated_At=TIME, Report_Data=TEXT
    ),
    "audit_log": _schema(
        LogID=LONG, Table_Name=TEXT, Operation=TEXT, Record_ID=LONG, Changed_By=TEXT, Change_Date=TIME,
        Old_Value=TEXT, New_Value=TEXT, Description=TEXT,
    ),
}

COMMAND_SCHEMA = _schema(
    cmd_id=LONG, event_ts=TIME, user_id=LONG, product_id=LONG, quantity=LONG, cmd_type=TEXT, notes=TEXT,
    actor=TEXT,
)

KEYS = {name: schema[0].name for name, schema in SCHEMAS.items()}


@dataclass(frozen=True)
class Rules:
    """Declared constraints of one table."""

    required: tuple[str, ...] = ()
    allowed: dict[str, tuple] = field(default_factory=dict)
    above: dict[str, int] = field(default_factory=dict)
    at_least: dict[str, int] = field(default_factory=dict)
    max_length: dict[str, int] = field(default_factory=dict)
    unique: tuple[str, ...] = ()


# The constraints and defaults the model declares.
FLAG = (0, 1)
RULES: dict[str, Rules] = {
    "users": Rules(
        required=("UserID", "Username", "Email", "Role", "Is_Active", "Created_At"),
        allowed={"Role": ("ADMIN", "MANAGER", "STAFF"), "Is_Active": FLAG},
        max_length={"Username": 50, "Email": 100, "Role": 20},
        unique=("UserID", "Email"),
    ),
    "category": Rules(
        required=("CategoryID", "Name", "IS_ACTIVE", "Created_At"),
        allowed={"IS_ACTIVE": FLAG},
        max_length={"Name": 100, "Description": 255},
        unique=("CategoryID", "Name"),
    ),
    "suppliers": Rules(
        required=("SupplierID", "Name", "Contact", "Is_Active", "Created_At"),
        allowed={"Is_Active": FLAG},
        max_length={"Name": 100, "Contact": 15, "Email": 100, "Address": 255},
        unique=("SupplierID", "Email"),
    ),
    "products": Rules(
        required=("ProductID", "Name", "CategoryID", "SupplierID", "Unit_Price", "Is_Active", "Created_At"),
        allowed={"Is_Active": FLAG},
        above={"Unit_Price": 0},
        max_length={"Name": 100},
        unique=("ProductID",),
    ),
    "stock_management": Rules(
        required=("StockID", "ProductID", "Quantity", "Restock_Level", "Last_Updated"),
        at_least={"Quantity": 0, "Restock_Level": 0},
        unique=("StockID", "ProductID"),
    ),
    "transactions": Rules(
        required=("TransactionID", "UserID", "Trans_Type", "Trans_Date", "Total_Amount"),
        allowed={"Trans_Type": ("SALE", "RETURN", "RESTOCK")},
        at_least={"Total_Amount": 0},
        max_length={"Trans_Type": 10, "Notes": 255},
        unique=("TransactionID",),
    ),
    "transaction_items": Rules(
        required=("ItemID", "TransactionID", "ProductID", "Quantity", "Unit_Price"),
        above={"Quantity": 0},
        at_least={"Unit_Price": 0},
        unique=("ItemID",),
    ),
    "reports": Rules(
        required=("ReportID", "Report_Type", "Generated_By", "Generated_At"),
        allowed={"Report_Type": ("DAILY_SALES", "STOCK_ALERT", "RESTOCK_SUMMARY", "CATEGORY_SUMMARY")},
        max_length={"Report_Type": 50},
        unique=("ReportID",),
    ),
    "audit_log": Rules(
        required=("LogID", "Table_Name", "Operation", "Changed_By", "Change_Date"),
        allowed={"Operation": ("INSERT", "UPDATE", "DELETE", "SELECT")},
        max_length={
            "Table_Name": 50, "Operation": 10, "Changed_By": 50, "Old_Value": 4000, "New_Value": 4000,
            "Description": 255,
        },
        unique=("LogID",),
    ),
}

# child table, child column, parent table, parent column
FOREIGN_KEYS = (
    ("products", "CategoryID", "category", "CategoryID"),
    ("products", "SupplierID", "suppliers", "SupplierID"),
    ("stock_management", "ProductID", "products", "ProductID"),
    ("transactions", "UserID", "users", "UserID"),
    ("transaction_items", "TransactionID", "transactions", "TransactionID"),
    ("transaction_items", "ProductID", "products", "ProductID"),
    ("reports", "Generated_By", "users", "UserID"),
)

# NOW stands for the load time, WHO for the acting user.
NOW, WHO = "now", "who"
DEFAULTS: dict[str, dict[str, object]] = {
    "users": {"Is_Active": 1, "Created_At": NOW},
    "category": {"IS_ACTIVE": 1, "Created_At": NOW},
    "suppliers": {"Is_Active": 1, "Created_At": NOW},
    "products": {"Is_Active": 1, "Created_At": NOW},
    "stock_management": {"Quantity": 0, "Restock_Level": 10, "Last_Updated": NOW},
    "transactions": {"Trans_Date": NOW, "Total_Amount": 0},
    "transaction_items": {},
    "reports": {"Generated_At": NOW},
    "audit_log": {"Changed_By": WHO, "Change_Date": NOW},
}
