"""Enumerations, thresholds, word lists and lookup tables.

These must equal the published model's values for results to agree; they are
data, and every operator that uses one accepts a replacement.
"""

# ---- fixed values: enumerations -------------------------------------------
PROVENANCE = ["bank_api", "upi_api", "sms_parser", "emi_statement",
              "open_banking_aa", "voice_stt_parser", "gst_portal", "eway_bill_nic"]
CHANNELS = ["BANK_TRANSFER", "UPI", "CARD", "ATM", "EMI", "OTHER"]
STATUSES = ["SUCCESS", "PENDING", "FAILED"]
TRANSACTION_TYPES = ["INCOME", "EXPENSE_ESSENTIAL", "EXPENSE_DISCRETIONARY",
                     "EMI_PAYMENT", "SUBSCRIPTION", "TRANSFER", "INVESTMENT",
                     "REFUND", "OTHER"]
CATEGORIES = ["SALARY", "GROCERY", "TRANSPORT", "DINING", "HEALTHCARE",
              "ENTERTAINMENT", "BILLS_UTILITIES", "EMI", "SUBSCRIPTION",
              "EDUCATION", "RENT", "INSURANCE", "CASH_ATM", "INVESTMENT",
              "TRANSFER", "OTHER"]
AGE_GROUPS = ["18-25", "26-35", "36-45", "46-55", "56+"]
RISK_LEVELS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]

# ---- fixed values: raw status -> canonical status -------------------------
STATUS_MAP = {
    "success": "SUCCESS", "pending": "PENDING", "failed": "FAILED",
    "failed_technical": "FAILED", "failed_funds": "FAILED", "active": "SUCCESS",
    "paid": "SUCCESS", "overdue": "FAILED", "cancelled": "FAILED",
}

# ---- fixed values: merchant rules, first match wins -----------------------
MERCHANT_RULES = [
    (r"\b(salary|payroll|remuneration|wage|pay\s*slip)\b", "SALARY"),
    (r"\b(emi|equated monthly|loan\s+installment|home\s+loan|car\s+loan)\b", "EMI"),
    (r"\b(atm|cash\s+withdrawal|cash\s+machine)\b", "CASH_ATM"),
    (r"\b(sip|mutual\s+fund|demat|zerodha|groww|ppf|nsc)\b", "INVESTMENT"),
    (r"\b(rent|landlord|pg\s+accommodation)\b", "RENT"),
    (r"\b(netflix|hotstar|spotify|prime\s+video|youtube\s+premium)\b", "ENTERTAINMENT"),
    (r"\b(pharmacy|medical|medicine|hospital|clinic|apollo|max\s+health|1mg|practo)\b", "HEALTHCARE"),
    (r"\b(electricity|broadband|mobile\s+recharge|airtel|jio|bsnl|bescom|tata\s+power)\b", "BILLS_UTILITIES"),
    (r"\b(petrol|diesel|fuel|hp\s+fuel|indian\s+oil|ola|uber|rapido|cab|taxi|auto\s+rickshaw)\b", "TRANSPORT"),
    (r"\b(restaurant|cafe|zomato|swiggy|pizza|biryani|burger|coffee)\b", "DINING"),
    (r"\b(grocery|kirana|dmart|reliance\s+fresh|big\s*basket|supermart|sabzi)\b", "GROCERY"),
    (r"\b(insurance|lic|policy\s+premium|term\s+life)\b", "INSURANCE"),
    (r"\b(college|school|tuition|byju|coursera|udemy|coaching)\b", "EDUCATION"),
    (r"\baa_balance_snapshot\b", "OTHER"),
]

# ---- fixed values: category -> transaction type ---------------------------
CATEGORY_TYPE = {
    "SALARY": "INCOME", "GROCERY": "EXPENSE_ESSENTIAL",
    "TRANSPORT": "EXPENSE_ESSENTIAL", "BILLS_UTILITIES": "EXPENSE_ESSENTIAL",
    "HEALTHCARE": "EXPENSE_ESSENTIAL", "RENT": "EXPENSE_ESSENTIAL",
    "INSURANCE": "EXPENSE_ESSENTIAL", "EDUCATION": "EXPENSE_DISCRETIONARY",
    "DINING": "EXPENSE_DISCRETIONARY", "ENTERTAINMENT": "EXPENSE_DISCRETIONARY",
    "CASH_ATM": "EXPENSE_DISCRETIONARY", "EMI": "EMI_PAYMENT",
    "SUBSCRIPTION": "SUBSCRIPTION", "INVESTMENT": "INVESTMENT",
    "TRANSFER": "TRANSFER", "OTHER": "OTHER",
}
SIGN_KEEPS_TYPE = ["INCOME", "TRANSFER", "REFUND", "INVESTMENT"]

# ---- fixed values: message intent rules, first match wins -----------------
CHAT_INTENT_RULES = [
    (r"(can\s+i\s+buy|can\s+i\s+purchase|afford|buy\s+a\s+car|car\s+loan|vehicle\s+loan|bike\s+loan)", "affordability"),
    (r"(liquidity|cash|buffer|survival)", "liquidity"),
    (r"(emi|loan|debt|repay)", "emi"),
    (r"(save|savings|invest|sip|rd)", "savings"),
    (r"(score|cibil|rating|credit)", "credit_score"),
    (r"(spend|expense|budget)", "spending"),
    (r"(future|forecast|next\s+\d+\s+days|predict)", "forecast"),
    (r"(improve|increase|better|boost)", "improvement"),
    (r"(explain|what|why|how)", "explain"),
]
NEGOTIATION_RULES = [
    (r"(accept|ok|confirm|yes|done)", "confirm"),
    (r"(reject|no|decline|cancel)", "reject"),
    (r"(lower emi|reduce emi|smaller emi)", "lower_emi"),
    (r"(longer|extend|12 month|tenure)", "extend_tenure"),
    (r"(moratorium|next month|defer)", "defer"),
]
YES_WORDS = r"(yes|correct|yeah|haan|absolutely)"
NO_WORDS = r"(no|nahi|not|never|nope)"
AMOUNT_PATTERN = r"₹?(\d[\d,]+)"
TIME_PATTERN = (r"\b(\d+\s*(?:day|week|month|year)s?|next\s+\w+|last\s+\w+|january|february|march"
                r"|april|may|june|july|august|september|october|november|december)\b")

# ---- fixed values: scam phrase patterns, case-insensitive -----------------
URGENCY_PATTERNS = [
    r"\bimmediate(?:ly)?\b",
    r"\burgent(?:ly)?\b",
    r"\baccount\s+(?:will\s+be\s+)?(?:suspended|blocked|frozen|disabled)\b",
    r"\b(?:within\s+)?24\s*hours?\b",
    r"\b(?:within\s+)?2\s*hours?\b",
    r"\blast\s+(?:chance|warning|notice)\b",
    r"\baction\s+required\b",
    r"\bdeadline\b",
    r"\bdo\s+not\s+(?:ignore|delay)\b",
    r"\bexpires?\s+(?:today|tonight|soon)\b",
    r"\bfinal\s+(?:notice|warning|reminder)\b",
    r"\bimmediately\s+(?:call|contact|reply)\b",
    r"\byour\s+(?:loan|account|card)\s+(?:will\s+be\s+)?(?:closed|cancelled|rejected)\b",
    r"\bsuspicious\s+activity\s+detected\b",
    r"\bunauthorized\s+(?:login|access|transaction)\b",
]
AUTHORITY_PATTERNS = [
    r"\bRBI\b",
    r"\bReserve\s+Bank\s+of\s+India\b",
    r"\bIncome\s+Tax\s+(?:Department|Officer|Notice)\b",
    r"\bIT\s+(?:Department|Notice|Raid)\b",
    r"\bCBI\b",
    r"\bED\b",
    r"\bEnforcement\s+Directorate\b",
    r"\bCyber\s+(?:Crime|Cell|Police)\b",
    r"\bBank\s+Head\s+Office\b",
    r"\bNPCI\b",
    r"\bSEBI\b",
    r"\bFIU\b",
    r"\bFinancial\s+Intelligence\s+Unit\b",
    r"\bTax\s+(?:Department|Authority|Notice)\b",
    r"\border\s+(?:from|of)\s+(?:court|government|RBI)\b",
    r"\bofficial\s+notice\b",
    r"\bgovernment\s+(?:order|notice|directive)\b",
]
CODE_REQUEST_PATTERNS = [
    r"\b(?:share|send|provide|give|tell)\s+(?:your\s+)?(?:OTP|one[\s-]time\s+password|6[\s-]digit(?:\s+code)?)\b",
    r"\bOTP\s+(?:is|sent|received)\b",
    r"\bverification\s+(?:code|pin|number)\b",
    r"\bdo\s+not\s+share\s+(?:(?:this|your)\s+)?OTP\b",
    r"\bconfirm(?:ation)?\s+(?:code|number|pin)\b",
    r"\bsecret\s+(?:code|pin|number)\b",
]
BARE_CODE_PATTERN = r"\b\d{6}\b"
REGISTERED_SENDER_PATTERN = r"^[A-Z]{2}-[A-Z]{4,6}$"
MESSAGE_SIGNALS = ("URGENCY_MANIPULATION", "AUTHORITY_IMPERSONATION", "OTP_PHISHING")

# ---- fixed values: credit bands -------------------------------------------
# band: (min score, max score, max loan in lakh, tenure months, apr low, apr high, guarantee eligible)
CREDIT_BANDS = {
    "very_low_risk": (750, 900, 20, 60, 8.5, 11.0, True),
    "low_risk": (650, 749, 10, 48, 11.0, 14.0, True),
    "medium_risk": (550, 649, 5, 36, 14.0, 18.0, False),
    "high_risk": (300, 549, 1, 12, 18.0, 24.0, False),
}
LOSS_GIVEN_DEFAULT = 0.45
MAX_EXPECTED_LOSS = 25_000.0

# ---- fixed values: feature norms (mean, std) ------------------------------
FEATURE_NORMS = {
    "emi_burden_ratio": (0.25, 0.10),
    "savings_rate": (0.15, 0.08),
    "income_stability_score": (0.75, 0.15),
    "spending_volatility_index": (0.35, 0.12),
    "cash_buffer_days": (25.0, 10.0),
    "discretionary_ratio": (0.25, 0.08),
    "debit_failure_rate_90d": (0.05, 0.04),
    "lifestyle_inflation_trend": (0.05, 0.10),
    "top3_merchant_concentration": (0.35, 0.12),
    "cash_dependency_index": (0.10, 0.08),
    "end_of_month_liquidity_dip": (5000.0, 3000.0),
}
HIGHER_IS_BETTER = ["savings_rate", "income_stability_score", "cash_buffer_days",
                    "income_7d", "income_30d", "income_90d",
                    "net_cashflow_30d", "net_cashflow_90d"]
LOWER_IS_BETTER = ["emi_burden_ratio", "spending_volatility_index",
                   "debit_failure_rate_90d", "cash_dependency_index",
                   "lifestyle_inflation_trend", "top3_merchant_concentration",
                   "end_of_month_liquidity_dip"]

# ---- fixed values: interrogation importance -------------------------------
SIGNAL_IMPORTANCE = {
    "emi_burden_ratio": 0.95,
    "debit_failure_rate_90d": 0.90,
    "cash_buffer_days": 0.85,
    "income_stability_score": 0.85,
    "savings_rate": 0.80,
    "spending_volatility_index": 0.75,
    "lifestyle_inflation_trend": 0.70,
    "discretionary_ratio": 0.65,
    "cash_dependency_index": 0.60,
    "top3_merchant_concentration": 0.55,
    "peer_cohort_benchmark_deviation": 0.50,
}
DEFAULT_IMPORTANCE = 0.40

# ---- fixed values: behaviour vector ---------------------------------------
VECTOR_DIM = 32
VECTOR_SEED = 0xC0FFEE
VECTOR_RANGES = {
    "emi_burden_ratio": (0.0, 2.0),
    "savings_rate": (-1.0, 1.0),
    "income_stability_score": (0.0, 1.0),
    "spending_volatility_index": (0.0, 3.0),
    "cash_buffer_days": (0.0, 90.0),
    "discretionary_ratio": (0.0, 1.0),
    "debit_failure_rate_90d": (0.0, 1.0),
    "lifestyle_inflation_trend": (-1.0, 2.0),
    "daily_avg_throughput_30d": (0.0, 500_000.0),
    "end_of_month_liquidity_dip": (0.0, 50_000.0),
    "subscription_count_30d": (0.0, 20.0),
    "emi_payment_count_90d": (0.0, 10.0),
    "top3_merchant_concentration": (0.0, 1.0),
    "cash_dependency_index": (0.0, 1.0),
    "peer_cohort_benchmark_deviation": (-3.0, 3.0),
    "income_7d": (0.0, 200_000.0),
    "income_30d": (0.0, 500_000.0),
    "income_90d": (0.0, 1_500_000.0),
    "net_cashflow_30d": (-300_000.0, 300_000.0),
    "net_cashflow_90d": (-500_000.0, 500_000.0),
}
VECTOR_PAIRS = [(3, 14), (4, 6), (2, 7), (0, 1), (8, 9), (5, 13),
                (10, 11), (12, 14), (16, 18), (17, 19), (1, 4), (0, 6)]

# ---- fixed values: volatility filter per persona (omega, alpha, beta) -----
VOLATILITY_PARAMS = {
    "genuine_healthy": (0.0002, 0.05, 0.90),
    "genuine_struggling": (0.0015, 0.18, 0.75),
    "shell_circular": (0.0030, 0.30, 0.60),
    "paper_trader": (0.0025, 0.25, 0.68),
    "new_to_credit": (0.0010, 0.12, 0.80),
    "unknown": (0.0010, 0.10, 0.85),
}

# ---- fixed values: regime income multipliers ------------------------------
REGIMES = ["STABLE", "STRESSED", "CRISIS"]
REGIME_INCOME_MULTIPLIER = {"STABLE": 1.0, "STRESSED": 0.75, "CRISIS": 0.40}
REGIME_INSTALMENT_LIKELIHOOD = {"STABLE": 0.90, "STRESSED": 0.60, "CRISIS": 0.20}

# ---- fixed values: scenarios ----------------------------------------------
# id: (income, essential, discretionary, miss delta, one-time, days, permanent, ramp start, ramp target)
ATOMIC_SCENARIOS = {
    "S_INC_DROP_20": (0.80, 1.0, 1.0, 0.0, 0.0, 30, False, -1, 1.0),
    "S_INC_RISE_20": (1.20, 0.95, 1.10, -0.03, 0.0, 45, False, -1, 1.0),
    "S_INC_DROP_50": (0.50, 1.0, 1.0, 0.0, 0.0, 60, False, -1, 1.0),
    "S_JOB_LOSS": (0.0, 1.08, 1.0, 0.15, 0.0, 90, False, 45, 0.50),
    "S_EXP_SURGE_30": (1.0, 1.30, 1.0, 0.0, 0.0, 30, False, -1, 1.0),
    "S_MEDICAL": (1.0, 1.0, 1.0, 0.10, 62500.0, 1, False, -1, 1.0),
    "S_RATE_HIKE": (1.0, 1.05, 1.0, 0.005, 0.0, 9999, True, -1, 1.0),
    "S_FRAUD": (0.0, 1.20, 1.0, 0.30, 0.0, 14, False, -1, 1.0),
}
COMPOUND_SCENARIOS = {
    "C_JOB_MEDICAL": ["S_JOB_LOSS", "S_MEDICAL"],
    "C_RATE_STRESS": ["S_RATE_HIKE", "S_EXP_SURGE_30"],
    "C_FRAUD_LOSS": ["S_FRAUD", "S_INC_DROP_20"],
    "C_FULL_STRESS": ["S_JOB_LOSS", "S_MEDICAL", "S_RATE_HIKE"],
}
# id: list of (atomic id, start day)
CASCADING_SCENARIOS = {
    "CA_INCOME_EMI": [("S_INC_DROP_20", 0)],
    "CA_FRAUD_SPIRAL": [("S_FRAUD", 0), ("S_INC_DROP_50", 14)],
    "CA_LIFESTYLE_DEBT": [("S_EXP_SURGE_30", 60)],
}

# ---- fixed values: model contract -----------------------------------------
FEATURE_COLUMNS = [
    "daily_avg_throughput_30d", "cash_buffer_days", "debit_failure_rate_90d",
    "end_of_month_liquidity_dip", "emi_burden_ratio", "savings_rate",
    "income_stability_score", "spending_volatility_index", "discretionary_ratio",
    "cash_dependency_index", "subscription_count_30d", "emi_payment_count_90d",
    "salary_day_spike_flag", "lifestyle_inflation_trend",
    "merchant_category_shift_count", "anomaly_flag", "top3_merchant_concentration",
    "peer_cohort_benchmark_deviation", "temporal_anomaly_flag", "income_7d",
    "income_30d", "income_90d", "essential_7d", "essential_30d", "essential_90d",
    "discretionary_7d", "discretionary_30d", "discretionary_90d",
    "net_cashflow_7d", "net_cashflow_30d", "net_cashflow_90d",
    "data_completeness_score", "gst_30d_value", "ewb_30d_value",
    "gst_filing_compliance_rate", "upi_p2m_ratio_30d", "gst_upi_receivables_gap",
    "hsn_entropy_90d", "statutory_payment_regularity_score", "months_active_gst",
]
DISCRETIONARY_COLUMNS = ["discretionary_ratio", "discretionary_30d", "discretionary_90d",
                         "lifestyle_inflation_trend", "subscription_count_30d"]
IMPUTE_REFERENCE = ["income_30d", "income_90d", "essential_30d", "essential_90d",
                    "daily_avg_throughput_30d"]
IMPUTE_TARGET = ["cash_buffer_days", "emi_burden_ratio", "savings_rate",
                 "debit_failure_rate_90d", "gst_30d_value", "ewb_30d_value",
                 "gst_filing_compliance_rate", "statutory_payment_regularity_score"]
CADENCE_COLUMNS = ["daily_avg_throughput_30d", "spending_volatility_index",
                   "income_stability_score", "debit_failure_rate_90d",
                   "top3_merchant_concentration", "discretionary_ratio",
                   "gst_filing_compliance_rate", "statutory_payment_regularity_score"]

# ---- fixed values: proxy label rules --------------------------------------
# (column, operator, threshold, increment), all that hold are added to the base
LABEL_BASE = 0.30
LABEL_RULES = [
    ("emi_burden_ratio", ">", 0.5, 0.30),
    ("emi_burden_ratio", ">", 0.3, 0.15),
    ("emi_burden_ratio", "<", 0.15, -0.05),
    ("savings_rate", "<", 0.0, 0.25),
    ("savings_rate", "<", 0.1, 0.10),
    ("savings_rate", ">", 0.3, -0.08),
    ("cash_buffer_days", "0<x<", 10.0, 0.20),
    ("cash_buffer_days", "0<x<", 5.0, 0.10),
    ("cash_buffer_days", ">", 45.0, -0.08),
    ("debit_failure_rate_90d", ">", 0.1, 0.20),
    ("debit_failure_rate_90d", ">", 0.3, 0.15),
    ("income_stability_score", "<", 0.5, 0.15),
    ("income_stability_score", "<", 0.3, 0.10),
    ("income_stability_score", ">", 0.85, -0.07),
    ("cash_dependency_index", ">", 0.4, 0.15),
    ("spending_volatility_index", ">", 1.0, 0.12),
    ("peer_cohort_benchmark_deviation", ">", 1.5, 0.12),
    ("peer_cohort_benchmark_deviation", "<", -1.0, -0.06),
    ("temporal_anomaly_flag", "=", 1.0, 0.18),
    ("net_cashflow_90d", "<", 0.0, 0.15),
    ("lifestyle_inflation_trend", ">", 0.3, 0.12),
    ("salary_day_spike_flag", "=", 1.0, 0.12),
    ("subscription_count_30d", ">", 4.0, 0.08),
    ("gst_filing_compliance_rate", "<", 0.8, 0.15),
    ("statutory_payment_regularity_score", "<", 0.7, 0.12),
    ("gst_upi_receivables_gap", ">", 0.4, 0.18),
    ("hsn_entropy_90d", ">", 2.0, -0.05),
    ("months_active_gst", ">", 12.0, -0.08),
    ("months_active_gst", "<", 3.0, 0.10),
]
LABEL_SHORT_TERM = (1000.0, 0.15)  # discretionary_7d above both income_7d and this adds the second value
LABEL_RANGE = (0.05, 0.95)

# ---- fixed values: triggers -----------------------------------------------
# trigger: (priority, channels)
TRIGGERS = {
    "liquidity_drop": ("HIGH", ["sms", "push"]),
    "prequalified_micro_loan_offer": ("HIGH", ["push"]),
    "overspend_warning": ("MEDIUM", ["push"]),
    "emi_at_risk": ("HIGH", ["sms", "push"]),
    "lifestyle_inflation": ("MEDIUM", ["push"]),
    "savings_opportunity": ("LOW", ["whatsapp"]),
    "fraud_anomaly": ("HIGH", ["push", "sms"]),
    "new_to_credit_guidance": ("LOW", ["whatsapp"]),
}
PRIORITY_ORDER = {"HIGH": 0, "MEDIUM": 1, "LOW": 2}

# The texts that users see, which must match word for word.
ALERT_TITLES = {
    "liquidity_drop": "Cash buffer alert", "prequalified_micro_loan_offer": "Pre-qualified micro-loan",
    "overspend_warning": "Overspend warning", "emi_at_risk": "EMI risk alert",
    "lifestyle_inflation": "Spending trend alert", "savings_opportunity": "Savings tip",
    "fraud_anomaly": "Account review required", "new_to_credit_guidance": "Build your credit profile",
}
OTHER_ALERT = "Financial alert"
# trigger: reason, with its measure
TRIGGER_REASONS = {
    "liquidity_drop": "Cash buffer at %.1f days (threshold: 10)",
    "prequalified_micro_loan_offer": "Liquidity dropped to %.1f days. Pre-qualified micro-loan offer is recommended proactively.",
    "overspend_warning": "Spending volatility at %.2f (threshold: 0.65)",
    "emi_at_risk": "EMI burden at %d%% of income (threshold: 35%%)",
    "lifestyle_inflation": "Spending volatility rose %d%% QoQ (threshold: 25%%)",
    "savings_opportunity": "Strong liquidity buffer with low burden — savings opportunity detected",
    "fraud_anomaly": "Circular trading / shell pattern detected in transaction graph",
    "new_to_credit_guidance": "Thin credit file detected — guidance mode active",
}
# trigger: what it suggests
TRIGGER_ACTIONS = {
    "liquidity_drop": ["Review non-essential subscriptions", "Defer discretionary spends for 7 days",
                       "Consider a short-term liquidity buffer via pre-qualified credit"],
    "prequalified_micro_loan_offer": ["Review pre-qualified micro-loan options", "Choose preferred EMI tenure and start date"],
    "overspend_warning": ["Set a weekly spending cap", "Review top 3 merchant categories"],
    "emi_at_risk": ["Request EMI restructuring with lender", "Reduce discretionary spend to build buffer",
                    "Explore balance transfer for lower EMI"],
    "lifestyle_inflation": ["Review discretionary spend categories", "Set savings target for next quarter"],
    "savings_opportunity": ["Consider SIP/RD with idle buffer", "Pre-pay high-interest EMI to save on interest"],
    "fraud_anomaly": ["Account flagged for manual review", "Credit offers suspended pending review"],
    "new_to_credit_guidance": ["Build credit history with a secured credit card", "Ensure salary is credited to this account regularly",
                               "Maintain 3 months of consistent digital transactions"],
}
REPORT_ACTIONS = {
    "buffer": "Reduce non-essential spend to rebuild cash buffer",
    "emi": "Contact lender to explore EMI restructuring",
    "spending": "Review top spending categories and set a weekly budget",
    "income": "Diversify income streams or ensure salary credits are regular",
    "none": "Maintain your current healthy financial habits",
}
