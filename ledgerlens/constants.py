"""Domain values of the operational data.

FIXED VALUES: these lists, labels and thresholds must equal the values of the
data model the analyses are defined on, in this order. Do not edit them to
make a result change.
"""

# --- fixed values: transaction domains -------------------------------------
TRANSACTION_TYPES = ["P2P Transfer", "Bill Payment", "Merchant Payment", "Refund", "Loan EMI", "Card Recharge"]
GATEWAYS = ["GatewayA", "GatewayB", "GatewayC", "GatewayD"]
DEVICE_TYPES = ["Android", "iOS", "Web", "POS-Terminal"]
MERCHANT_CATEGORIES = ["Grocery", "Utilities", "E-commerce", "Travel", "Fuel", "Healthcare", "Entertainment", "P2P"]
FAILURE_REASONS = [
    "Insufficient Funds", "Gateway Timeout", "Bank Server Down", "Invalid Credentials",
    "Network Error", "Fraud Block", "Limit Exceeded", "OTP Expired", "Issuer Decline",
]

# --- fixed values: ticket domains --------------------------------------------
ISSUE_CATEGORIES = [
    "Failed Transaction", "Refund Delay", "Account Access", "KYC Issue",
    "Card Block/Unblock", "Dispute/Chargeback", "App/Tech Issue", "Billing Query",
]
TICKET_CHANNELS = ["App Chat", "Email", "Phone", "Social Media"]
AGENT_TEAMS = ["Tier1-Support", "Tier2-Technical", "Fraud-Risk", "Billing-Ops", "Premium-Care"]
SLA_TARGET_BY_PRIORITY = {"Critical": 4, "High": 12, "Medium": 24, "Low": 48}
TEAM_PENALTY_HOURS = {"Fraud-Risk": 10.0, "Tier2-Technical": 5.0}
CLOSED_TICKET_STATUSES = ["Resolved", "Closed", "Reopened"]
LINKABLE_TRANSACTION_STATUSES = ["Failed", "Reversed"]

# --- fixed values: labels and thresholds of the analyses ---------------------
SLA_OUTCOME_LABELS = {0: "SLA Met", 1: "SLA Breached"}
SLA_RISK_LABELS = ("BREACHED", "AT RISK", "ON TRACK")
SLA_AT_RISK_SHARE = 0.8
AGENT_MIN_TICKETS = 20
OUTLIER_Z = 3.0
REASON_Z = 2.5
HIGH_RETRIES = 3
HIGH_RISK_SCORE = 75
REASON_TAGS = ("Slow processing", "Unusual amount", "High retries", "High risk score", "Failed txn")
DEFAULT_REASON = "Multivariate pattern"
PRIORITY_WEIGHTS = (0.55, 0.30, 0.15)   # anomaly score, amount, fraud flag
MINMAX_EPS = 1e-9

# --- fixed values: columns of the ranked anomaly table ------------------------
ANOMALY_COLUMNS = [
    "transaction_id", "timestamp", "gateway", "channel", "amount", "status",
    "processing_time_ms", "retry_count", "risk_score", "anomaly_reason", "priority_score",
]

# --- fixed values: anomaly model parameters ----------------------------------
FOREST_TREES = 150
FOREST_MAX_SAMPLES = 256
FOREST_SEED = 42
DEFAULT_CONTAMINATION = 0.02
DEFAULT_TOP_N = 25
DASHBOARD_TOP_N = 20
DASHBOARD_SAMPLE_SEED = 1
PREVIEW_ROWS = 1000
FEATURES = ["processing_time_ms", "amount", "retry_count", "risk_score"]

# --- fixed values: generator rules kept as enrichment operators ---------------
NIGHT_HOURS = (1, 4)
BASE_FAILURE_PROB = 0.07
GATEWAY_C_FAILURE_PROB = 0.18
NIGHT_FAILURE_BOOST = 0.06
HIGH_AMOUNT = 100000
HIGH_AMOUNT_RISK = 12
NEW_ACCOUNT_DAYS = 30
NEW_ACCOUNT_RISK = 15
LINKED_TICKET_SHARE = 0.6
