"""Fixed values the billing domain agrees on. Results depend on them, so they are plain data."""

from decimal import Decimal

# Task statuses, in display order.
STATUS_ORDER = ["new", "error", "reviewed", "finished", "excluded"]

# Raw statuses that count as still waiting.
WAITING_STATUSES = ["waiting", "rap_running", "usage_running"]

# Static exchange rates to USD; any other currency counts as 1.00.
FX_TO_USD = {
    "USD": Decimal("1"),
    "CAD": Decimal("0.74"),
    "GBP": Decimal("1.24"),
    "EUR": Decimal("1.07"),
    "NOK": Decimal("0.091"),
    "SEK": Decimal("0.092"),
    "DKK": Decimal("0.14"),
    "AUD": Decimal("0.66"),
    "NZD": Decimal("0.61"),
    "THB": Decimal("0.029"),
    "IDR": Decimal("0.000067"),
    "MYR": Decimal("0.22"),
    "SGD": Decimal("0.74"),
    "VND": Decimal("0.000043"),
    "PHP": Decimal("0.018"),
}
FX_DEFAULT = Decimal("1.00")

# Billing methods by category.
INVOICE_METHODS = ["createPartnerInvoice", "createCompanyInvoice"]
TAX_METHODS = [
    "calculateAndStoreSalesTaxRatesForPartner",
    "calculateAndStoreSalesTaxRatesForCompany",
]
RELEASE_METHODS = ["sendInvoiceForCompany", "sendInvoiceForPartner"]
BILLING_METHODS = INVOICE_METHODS + TAX_METHODS + RELEASE_METHODS
METHOD_CATEGORIES = {
    "Invoice Generation": INVOICE_METHODS,
    "Tax Calculations": TAX_METHODS,
    "Invoice Release": RELEASE_METHODS,
}
ARREARS_BILL_METHOD = "createArrearsBillsForSubscription"
USAGE_RECORD_METHOD = "createUsageRecordsForSubscription"

# The task tables, and the sets of them that each report scans.
MCA_TABLES = ["mca_task", "mca_task_2", "mca_task_3", "mca_task_4", "mca_task_5"]
ARREARS_TABLES = ["arrears_task", "arrears_task_2"]
DURATION_TABLES = ["billing_task", "billing_task_2"] + MCA_TABLES
DEEP_DIVE_TABLES = DURATION_TABLES + ["report_task", "erp_task"]
CATEGORY_TABLES = DURATION_TABLES + ["widget_task", "report_task", "erp_task"]
BACKLOG_TABLES = ["billing_task", "billing_task_2"] + ARREARS_TABLES + MCA_TABLES + ["widget_task"]

# Label of each task table in the latest-task report.
TASK_TYPES = {
    "billing_task": "Billing",
    "billing_task_2": "Billing",
    "arrears_task": "Arrears",
    "arrears_task_2": "Arrears",
    "mca_task": "MCA",
    "mca_task_2": "MCA",
    "mca_task_3": "MCA",
    "mca_task_4": "MCA",
    "mca_task_5": "MCA",
    "widget_task": "Widget",
}

# Invoice release statuses, in display order.
RELEASE_STATUSES = ["Released", "Held - Approved", "Held - Needs Review", "Void"]

# Placeholder methods of a task table that could not be counted.
BACKLOG_PLACEHOLDERS = {
    "table_not_found": "Table not found in database",
    "no_data": "No open tasks",
}
