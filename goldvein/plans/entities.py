"""The entity registry: canonical columns, aliases, checks and vocabularies of the fourteen built-in entities.

All tables here are fixed values: they must equal what users of such data rely on."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: staging columns of the five staged entities
STAGING = {
    "Customers": ["customer_id", "full_name", "email", "phone", "country", "city", "address", "status"],
    "Vendors": ["vendor_id", "vendor_name", "contact_email", "contact_phone", "country", "status"],
    "Products": ["sku", "product_name", "category", "price", "msrp", "supplier_id", "stock"],
    "Invoices": ["invoice_no", "customer_id", "amount", "currency", "invoice_date", "due_date", "status", "description"],
    "Employees": ["employee_id", "full_name", "email", "phone", "department_code", "department_name", "country", "hire_date", "status", "manager_id", "salary"],
}
#: canonical staging column <- source spellings
STAGING_ALIASES = {
    "customer_id": ["cust_nr", "cust_id", "cust_key", "cust_no", "id", "customer", "lead_id"],
    "employee_id": ["emp_no", "emp_id"],
    "vendor_id": ["vendor_nr", "vendor_code", "supplier_id"],
    "invoice_no": ["bill_no", "invoice_id", "order_number", "order_id"],
    "sku": ["prod_code", "product_id", "product_sku", "product_code"],
    "full_name": ["full_nm", "name", "contact_nm", "emp_full_name", "name1", "customer_name"],
    "vendor_name": ["company_nm", "vendor_nm", "company_name"],
    "product_name": ["product_nm", "desc1", "description"],
    "email": ["work_email", "email_addr", "email_adr"],
    "phone": ["mobile_nr", "phone_nr", "tel_nr"],
    "contact_phone": ["contact_tel"],
    "country": ["ctry", "ctry_cd", "country_code", "land", "customer_country", "shipping_country"],
    "city": ["stadt", "customer_city", "shipping_city"],
    "address": ["shipping_address", "addr"],
    "department_code": ["dept_cd", "dept"],
    "department_name": ["dept_nm"],
    "hire_date": ["hire_dt"],
    "salary": ["annual_sal", "salary_usd"],
    "status": ["status_cd", "stat", "order_status", "payment_status"],
    "manager_id": ["mgr_id"],
    "amount": ["amount", "amt", "opp_amt", "total"],
    "price": ["unit_price"],
    "invoice_date": ["crt_dt", "order_dt", "order_date", "crdat"],
    "due_date": ["due_dt"],
    "category": ["category", "cat", "product_category"],
}
ALIAS_OF = {spelling: canon for canon, spellings in STAGING_ALIASES.items() for spelling in spellings}

#: master table, primary key, canonical column <- aliases in order of preference
MASTERS = {
    "Customers": ("master_customers", "customer_id", {
        "customer_id": ["customer_id", "cust_id", "cust_no", "custno", "id", "client_id", "crm_id"], "full_name": ["full_name", "name", "name1", "customer_name", "client_name", "fullname"], "email": ["email", "mail", "e_mail", "email_address", "email_adr"],
        "phone": ["phone", "mobile", "telephone", "cell", "contact_phone", "phone_nr"], "city": ["city", "town"], "country": ["country", "country_name", "country_code", "nation"], "address": ["address", "addressline1", "street", "address_line_1"],
        "status": ["status", "state", "active"], "created_at": ["created_at", "created", "registration_date", "signup_date"]}),
    "Vendors": ("master_vendors", "vendor_id", {
        "vendor_id": ["vendor_id", "vendor_code", "supplier_id", "id"], "vendor_name": ["vendor_name", "name", "company_name", "supplier_name"], "contact_phone": ["contact_phone", "phone", "telephone", "mobile"],
        "country": ["country", "country_name", "nation"], "status": ["status", "active", "state"]}),
    "Products": ("master_products", "sku", {
        "sku": ["sku", "product_code", "item_code", "product_sku", "prod_code"], "product_name": ["product_name", "name", "title", "description"], "category": ["category", "product_category", "type", "product_line"], "price": ["price", "unit_price", "cost"],
        "msrp": ["msrp", "list_price", "retail_price"], "supplier_id": ["supplier_id", "vendor_id", "supplier"], "stock": ["stock", "quantity", "inventory", "qty"]}),
    "Invoices": ("master_invoices", "invoice_no", {
        "invoice_no": ["invoice_no", "invoice_number", "bill_no", "bill_nr", "order_number", "receipt_no", "invoice_id"], "customer_id": ["customer_id", "client_id", "cust_id"], "amount": ["amount", "total", "line_total", "total_amount", "value", "amt"],
        "due_date": ["due_date", "due", "payment_due"], "invoice_date": ["invoice_date", "issue_date", "order_date", "date"], "status": ["status", "payment_status", "state"], "description": ["description", "notes", "memo", "item_description"],
        "bill_to_name": ["bill_to_name", "billed_to", "customer_name"], "vendor": ["vendor", "vendor_name", "supplier", "from"], "line_item_count": ["line_item_count"], "line_items_sum": ["line_items_sum"], "line_items_json": ["line_items_json"]}),
    "Employees": ("master_employees", "employee_id", {
        "employee_id": ["employee_id", "emp_id", "emp_no", "empno", "empid", "id"], "full_name": ["full_name", "name", "full_nm", "fullname", "employee_name"], "email": ["email", "mail", "work_email", "email_address", "e_mail"], "phone": ["phone", "mobile", "mobile_nr", "telephone", "phone_nr", "cell"],
        "department_code": ["department_code", "dept_cd", "dept_code", "department_id"], "department_name": ["department_name", "dept_nm", "dept_name", "department"], "country": ["country", "ctry", "land", "land_code", "country_code"],
        "hire_date": ["hire_date", "hire_dt", "start_date", "joined", "crdat"], "status": ["status", "state", "employment_status"], "manager_id": ["manager_id", "mgr_id", "manager", "reports_to"], "salary": ["salary", "salary_usd", "annual_salary", "comp", "pay"]}),
    "Accounts": ("master_accounts", "acct_id", {
        "acct_id": ["acct_id", "account_id", "acc_id"], "account_name": ["account_name", "acct_name", "name", "company_name"], "annual_revenue": ["annual_revenue", "revenue", "yearly_revenue", "arr"], "employee_count": ["employee_count", "emp_count", "headcount", "num_employees"],
        "industry": ["industry", "sector", "vertical"], "country": ["country", "ctry", "country_code"], "status": ["status", "state", "account_status"]}),
    "Contracts": ("master_contracts", "contract_id", {
        "contract_id": ["contract_id", "ct_id", "contract_no"], "acct_id": ["acct_id", "account_id", "customer_acct_id"], "contract_value": ["contract_value", "value", "amount", "contract_amt"], "start_dt": ["start_dt", "start_date", "started", "effective_date"],
        "end_dt": ["end_dt", "end_date", "expires", "expiration_date"], "status": ["status", "contract_status", "state"]}),
    "Departments": ("master_departments", "department_code", {
        "department_code": ["department_code", "dept_code", "dept_cd", "dept_id"], "dept_name": ["dept_name", "department_name", "name"], "cost_center": ["cost_center", "cc", "cost_cd", "cost_centre"], "manager_emp_id": ["manager_emp_id", "manager_id", "manager", "mgr_id"]}),
    "Inventory": ("master_inventory", "inv_item_id", {
        "inv_item_id": ["inv_item_id", "item_id", "inventory_id", "stock_id"], "sku": ["sku", "product_sku", "product_id"], "loc_id": ["loc_id", "location_id", "warehouse_id"], "quantity": ["quantity", "qty", "stock", "on_hand"], "unit_cost": ["unit_cost", "cost", "cost_price"],
        "last_count_dt": ["last_count_dt", "last_counted", "count_date"]}),
    "Locations": ("master_locations", "loc_id", {
        "loc_id": ["loc_id", "location_id", "site_id", "warehouse_id"], "city": ["city", "town"], "country": ["country", "ctry", "country_code"], "acct_id": ["acct_id", "account_id"], "address": ["address", "street", "addr"]}),
    "Opportunities": ("master_opportunities", "opp_id", {
        "opp_id": ["opp_id", "opportunity_id", "deal_id"], "opp_name": ["opp_name", "opportunity_name", "deal_name", "name"], "acct_id": ["acct_id", "account_id"], "owner_emp_id": ["owner_emp_id", "owner", "owner_id", "sales_rep", "rep_id"],
        "amount": ["amount", "value", "deal_size", "opp_amount"], "status": ["status", "stage", "opp_stage"], "close_dt": ["close_dt", "close_date", "expected_close", "closed_dt"]}),
    "Payments": ("master_payments", "pmt_id", {
        "pmt_id": ["pmt_id", "payment_id", "pay_id"], "pmt_amt": ["pmt_amt", "amount", "payment_amount", "pay_amt"], "reference_no": ["reference_no", "ref_no", "ref", "reference"], "pmt_dt": ["pmt_dt", "payment_date", "paid_dt", "pay_date"],
        "invoice_no": ["invoice_no", "invoice_id", "bill_no"], "customer_id": ["customer_id", "cust_id"], "method": ["method", "payment_method", "pay_method"]}),
    "Shipments": ("master_shipments", "ship_id", {
        "ship_id": ["ship_id", "shipment_id", "shp_id"], "invoice_no": ["invoice_no", "order_no", "order_id"], "tracking_no": ["tracking_no", "tracking", "track_id", "tracking_number"], "shipped_dt": ["shipped_dt", "ship_date", "shipment_date"],
        "status": ["status", "shipment_status"], "carrier": ["carrier", "carrier_name", "shipper"]}),
    "SalesOrders": ("master_sales_orders", "order_id", {
        "order_id": ["order_id", "order_number", "order_no", "ord_id"], "customer_id": ["customer_id", "cust_id"], "product_id": ["product_id", "product_sku", "sku"], "amount": ["amount", "unit_price", "price"], "quantity": ["quantity", "qty"],
        "total_amt": ["total_amt", "total", "total_amount"], "order_date": ["order_date", "ord_date", "date", "invoice_date"], "status": ["status", "order_status"]}),
}

#: status vocabularies
PARTY = ["Active", "Inactive", "Terminated", "On Leave", "Pending", "Suspended", "Unknown"]
STATUSES = {
    "Customers": PARTY, "Vendors": PARTY, "Employees": PARTY, "Accounts": PARTY,
    "Invoices": ["Paid", "Unpaid", "Open", "Pending", "Overdue", "Cancelled", "Refunded", "Draft", "Unknown"],
    "Shipments": ["Shipped", "Delivered", "In Transit", "Processing", "Returned", "Lost", "Cancelled", "Unknown"],
    "Opportunities": ["Open", "Won", "Lost", "In Progress", "Qualified", "Proposal", "Negotiation", "Closed", "Closed-Won", "Closed-Lost", "Prospect", "Unknown"],
    "Contracts": ["Active", "Expired", "Terminated", "Pending", "Cancelled", "Renewed", "Draft", "Unknown"],
    "SalesOrders": ["Open", "Shipped", "Delivered", "Cancelled", "Returned", "Pending", "Processing", "Unknown"],
}
#: entity-specific renaming of generic statuses at ingest
STATUS_RENAMES = {"Invoices": {"Active": "Open", "Inactive": "Paid"}, "Shipments": {"Active": "Shipped", "Inactive": "Delivered"}}

#: key patterns
KEY = {
    "customer": r"^C-[0-9]{4,6}$", "vendor": r"^V-[0-9]{4,6}$", "product": r"^(SKU-[A-Z0-9-]+|P-[0-9]+)$", "invoice": r"^(INV|BILL)-([0-9]{4}-)?[0-9]{4,6}$", "employee": r"^E-[0-9]{4,6}$",
    "account": r"^A-[0-9]{4,6}$", "contract": r"^CT-[0-9]{4,6}$", "department": r"^D-[0-9]{3,5}$", "location": r"^LOC-[0-9]{4,6}$", "opportunity": r"^OPP-[0-9]{4,6}$", "payment": r"^PMT-[0-9]{4,6}$",
    "shipment": r"^SHP-[0-9]{4,6}$", "inventory": r"^INVT-[0-9]{4,6}$", "salesorder": r"^(SO|ORD|O)-[0-9]{4,6}$", "party": r"^[CV]-[0-9]{4,6}$",
}


@dataclass(frozen=True)
class Check:
    """A named rule of one column: kind is regex, number (at least 0), integer, email, phone, status, nonblank or blank."""

    column: str
    kind: str
    value: object = None


def checks(key: str, pattern: str, *more: Check, entity: str = "") -> list[Check]:
    status = [Check("status", "status", tuple(STATUSES[entity]))] if entity in STATUSES else []
    return [Check(key, "regex", KEY[pattern]), *more, *status]


at_least_0 = lambda *columns: [Check(c, "number") for c in columns]
like = lambda column, pattern: Check(column, "regex", KEY[pattern])

SCHEMAS: dict[str, list[Check]] = {
    "Customers": checks("customer_id", "customer", Check("full_name", "nonblank"), Check("email", "email"), Check("phone", "phone"), entity="Customers"),
    "Vendors": checks("vendor_id", "vendor", Check("vendor_name", "nonblank"), Check("contact_phone", "phone"), Check("full_name", "blank"), entity="Vendors"),
    "Products": checks("sku", "product", Check("product_name", "nonblank"), *at_least_0("price", "msrp"), like("vendor_id", "vendor")),
    "Invoices": checks("invoice_no", "invoice", like("customer_id", "party"), *at_least_0("amount"), entity="Invoices"),
    "Employees": checks("employee_id", "employee", Check("full_name", "nonblank"), Check("email", "email"), Check("phone", "phone"), *at_least_0("salary"), like("department_code", "department"), entity="Employees"),
    "Accounts": checks("acct_id", "account", *at_least_0("annual_revenue"), Check("employee_count", "integer"), entity="Accounts"),
    "Contracts": checks("contract_id", "contract", like("acct_id", "account"), *at_least_0("contract_value"), entity="Contracts"),
    "Departments": checks("department_code", "department", Check("dept_name", "nonblank"), like("manager_emp_id", "employee")),
    "Locations": checks("loc_id", "location", Check("city", "nonblank"), like("acct_id", "account")),
    "Opportunities": checks("opp_id", "opportunity", *at_least_0("amount"), like("acct_id", "account"), like("owner_emp_id", "employee"), entity="Opportunities"),
    "Payments": checks("pmt_id", "payment", *at_least_0("pmt_amt"), like("invoice_no", "invoice"), like("customer_id", "customer")),
    "Shipments": checks("ship_id", "shipment", entity="Shipments"),
    "Inventory": checks("inv_item_id", "inventory", Check("quantity", "integer"), *at_least_0("unit_cost"), like("sku", "product"), like("loc_id", "location")),
    "SalesOrders": checks("order_id", "salesorder", *at_least_0("amount", "total_amt"), Check("quantity", "integer"), like("customer_id", "customer"), entity="SalesOrders"),
}
REQUIRED = {"Customers": ["customer_id", "full_name"], "Vendors": ["vendor_id", "vendor_name"], "Products": ["sku", "product_name"], "Employees": ["employee_id", "full_name"], "Departments": ["department_code", "dept_name"]}

AUDIT = {"source_dataset_id": "string", "source_row_index": "long", "ingested_at": "string", "last_updated": "string", "merged_from_count": "long", "confidence_score": "double", "archived_at": "string"}


@dataclass
class Entity:
    name: str
    table: str
    key: str
    fields: dict[str, list[str]]
    checks: list[Check] = field(default_factory=list)

    @property
    def columns(self) -> list[str]:
        return list(self.fields)


def built_in() -> dict[str, Entity]:
    return {n: Entity(n, t, k, {c: list(a) for c, a in f.items()}, SCHEMAS[n]) for n, (t, k, f) in MASTERS.items()}


REGISTRY: dict[str, Entity] = built_in()


def register(entity: Entity) -> None:
    REGISTRY[entity.name] = entity


#: keyword -> entity, first hit wins
LANDING_RULES = [(["customer", "client", "contact"], "audit", "Customers"), (["vendor", "supplier"], "", "Vendors"), (["product", "sku"], "", "Products"), (["invoice", "bill", "order"], "shipment", "Invoices"), (["employee", "staff"], "", "Employees"), (["customer_audit"], "", "Customers")]
FILE_RULES = [
    (["customer", "contact", "client", "audit"], "Customers"), (["vendor", "supplier"], "Vendors"), (["product", "sku", "catalog", "quarterly"], "Products"), (["invoice", "bill", "billing", "receipt"], "Invoices"), (["order", "sales_order"], "SalesOrders"),
    (["employee", "staff", "personnel", "hr"], "Employees"), (["account"], "Accounts"), (["contract"], "Contracts"), (["department", "dept"], "Departments"), (["inventor"], "Inventory"), (["location", "address", "site"], "Locations"),
    (["opportunit"], "Opportunities"), (["payment"], "Payments"), (["shipment", "shipping"], "Shipments"),
]
FILE_HINTS = {
    "order": "SalesOrders", "sales": "SalesOrders", "invoice": "Invoices", "bill": "Invoices", "shipment": "Shipments", "ship": "Shipments", "customer": "Customers", "vendor": "Vendors", "supplier": "Vendors", "employee": "Employees",
    "product": "Products", "payment": "Payments", "opportun": "Opportunities", "contract": "Contracts", "account": "Accounts", "location": "Locations", "department": "Departments", "inventory": "Inventory",
}
KEY_ENTITIES = {
    "Customers": ["customer_id", "cust_id", "cust_no"], "Vendors": ["vendor_id", "supplier_id", "vendor_code"], "Products": ["sku", "product_id", "prod_code"], "Employees": ["employee_id", "emp_id", "emp_no"], "Invoices": ["invoice_no", "invoice_id", "bill_no", "order_id", "order_number"],
    "Departments": ["dept_cd", "dept_id", "department_code"], "Accounts": ["acct_id", "account_id"], "Contracts": ["contract_id"], "Locations": ["loc_id", "location_id"], "Opportunities": ["opp_id"], "Payments": ["pmt_id", "payment_id"], "Shipments": ["ship_id"],
    "Inventory": ["inv_item_id"], "Warehouses": ["warehouse_id"], "Managers": ["manager_id"],
}
ENTITY_OF_KEY = {k: e for e, ks in KEY_ENTITIES.items() for k in ks}


def entity_for_landing(name: str) -> str | None:
    low = name.lower()
    return next((e for words, but, e in LANDING_RULES if any(w in low for w in words) and not (but and but in low)), None)


def entity_for_file(name: str) -> str | None:
    low = name.lower()
    return next((e for words, e in FILE_RULES if any(w in low for w in words)), None)


def file_entity(name: Column) -> Column:
    """``entity_for_file`` of a column of names."""
    low = F.lower(name)
    return F.coalesce(*[F.when(low.rlike("|".join(words)), F.lit(e)) for words, e in FILE_RULES])


def entity_for_key(column: str, source: str = "") -> str:
    canon = column.lower().strip()
    if canon in ENTITY_OF_KEY:
        return ENTITY_OF_KEY[canon]
    if m := re.fullmatch(r"(.+?)(?:_id|_no|_key|_code|_nr)", canon):
        return m[1].capitalize() + "s"
    stem = re.sub("^(?:rest_api_|api_|sqlite_|file_|pdf_)", "", source)
    return "".join(p.capitalize() for p in re.split(r"[_\s]+", stem) if p) or "Unknown"
