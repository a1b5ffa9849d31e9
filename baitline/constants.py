"""Rule constants.

Everything below the FIXED VALUES marker must equal the rules being matched
(pattern texts, word lists, weights, thresholds, step texts), so it is kept
plainly, in the original order. Report headers and model-facing texts that
named a product are neutral here.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (must stay equal to the matched rules; order is significant)
# ---------------------------------------------------------------------------

# PII patterns, applied in this order: email, SSN, national id, card, phone.
EMAIL_PATTERN = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
SSN_PATTERN = r"\b\d{3}-\d{2}-\d{4}\b"
NATIONAL_ID_PATTERN = r"\b[1-8]\d{12}\b"
CARD_PATTERN = r"\b(?:\d[ -]*?){13,16}\b"
PHONE_PATTERN = r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"

EMAIL_MASK = "[REDACTED_EMAIL]"
SSN_MASK = "[REDACTED_SSN]"
CARD_MASK = "[REDACTED_CREDIT_CARD]"
PHONE_MASK = "[REDACTED_PHONE]"
SCREENSHOT_TEXT_MASK = "[REDACTED_SCREENSHOT_TEXT]"

# Ordered redaction passes (pattern, replacement).
REDACTION_PASSES = [
    (EMAIL_PATTERN, EMAIL_MASK),
    (SSN_PATTERN, SSN_MASK),
    (NATIONAL_ID_PATTERN, SSN_MASK),
    (CARD_PATTERN, CARD_MASK),
    (PHONE_PATTERN, PHONE_MASK),
]

# Link pattern (case-sensitive).
URL_PATTERN = r"(https?://[^\s/$.?#].[^\s]*|www\.[^\s/$.?#].[^\s]*)"

# Characters whose compatibility form (NFKC) holds one of "/?#@:"; a host with one is not a URL.
NFKC_DELIMITERS = "⁇⁈⁉℀℁℅℆⩴︓︖﹕﹖﹟﹫＃／：？＠"

BRANDS = [
    "dhl", "fedex", "ups", "usps", "royal mail",
    "paypal", "revolut", "netflix", "amazon", "ebay", "coinbase",
    "bank of america", "chase", "wells fargo", "hsbc", "ing", "raiffeisen",
    "mastercard", "google", "microsoft", "apple",
    "facebook", "instagram", "whatsapp", "telegram",
]

SUSPICIOUS_TLDS = [
    ".xyz", ".top", ".club", ".info", ".support", ".link", ".cc",
    ".work", ".click", ".gq", ".cf", ".tk", ".ml", ".ga", ".today", ".live",
]

TYPO_PATTERNS = [
    ("paypa1", "paypal"), ("pay-pal", "paypal"),
    ("netfl1x", "netflix"), ("netf1ix", "netflix"),
    ("revo1ut", "revolut"), ("rev-olut", "revolut"),
    ("arnazon", "amazon"), ("amaz0n", "amazon"),
    ("g00gle", "google"), ("micr0soft", "microsoft"),
]

TLD_POINTS = 30
BRAND_POINTS = 40
HYPHEN_POINTS = 15
DIGIT_POINTS = 10
TYPO_POINTS = 50

# Indicator texts of a domain report.
TLD_TEXT = "Suspicious top-level domain: "
IMPERSONATES_TEXT = ("Impersonates brand '", "' in a suspicious domain layout")
HYPHENS_TEXT = "Contains multiple hyphens, typical of phishing domain naming patterns"
DIGITS_TEXT = "Contains multiple digits, often used to bypass spam filters"
TYPO_TEXT = "Typosquatting attempt mimicking '"

DOMAIN_HIGH = 70
DOMAIN_MEDIUM = 30
SCORE_HIGH = 70
SCORE_MEDIUM = 35

URGENCY = "Urgency & Pressure"
BRAND = "Brand Impersonation"
FINANCIAL = "Financial Request"
DATA = "Data Collection Prompt"
RELATIONSHIP = "Relationship Exploitation"

URGENCY_KEYWORDS = [
    "urgent", "imediata", "imediat", "suspendat", "suspend", "blocat", "block",
    "24 ore", "24h", "limita", "expira", "de urgenta", "penalizare", "amenda",
    "immediately", "restrict", "action required", "atentie",
]
FINANCIAL_KEYWORDS = [
    "pay", "payment", "fee", "tax", "invoice", "customs", "delivery fee",
    "outstanding", "refund", "card", "account", "bank", "transfer",
    "wire", "gift card", "crypto", "won", "winner", "reward", "voucher",
    "claim", "prize", "package", "parcel", "shipment", "delivered", "delivery",
    "plateste", "plata", "taxa", "restituire", "vama", "cont", "castig", "premiu",
]
DATA_KEYWORDS = [
    "verificare", "confirma", "conecteaza-te", "autentifica", "update", "login",
    "verify", "verification", "confirm", "update credentials", "secure account",
    "reactivate", "sign in", "signin", "password", "2fa", "code", "otp",
    "phone", "email", "ssn", "social security", "national id", "identity",
]
RELATIONSHIP_KEYWORDS = [
    "love you", "dear", "visa fee", "send money", "do not tell", "don't tell",
    "keep this secret", "emergency help", "need money", "cannot wait",
]

# (category, keywords, detail prefix); None keywords = brand word match.
SIGNAL_CATEGORIES = [
    (URGENCY, URGENCY_KEYWORDS, "High urgency words detected: "),
    (BRAND, None, "Claimed source: "),
    (FINANCIAL, FINANCIAL_KEYWORDS, "Financial or delivery terminology detected: "),
    (DATA, DATA_KEYWORDS, "Account verification request: "),
    (RELATIONSHIP, RELATIONSHIP_KEYWORDS, "Trust-building or isolation language detected: "),
]

# category -> (impact, severity); any other category is 10 / low.
CATEGORY_WEIGHTS = {
    URGENCY: (14, "medium"),
    BRAND: (12, "medium"),
    FINANCIAL: (14, "high"),
    DATA: (16, "high"),
    RELATIONSHIP: (22, "high"),
}
DEFAULT_WEIGHT = (10, "low")

BREAKDOWN_DOMAIN = "Unsafe destination link detected."
BREAKDOWN_LINES = [
    (URGENCY, "Artificial sense of urgency or threat detected."),
    (BRAND, "Appears to impersonate a trusted company/institution."),
    (FINANCIAL, "Asks for immediate payment, bank details, or delivery fees."),
    (DATA, "Contains phishing hooks to harvest credentials or verification codes."),
]
BREAKDOWN_NONE = "No common scam signatures identified in the message structure."

TRACE_DOMAIN_LABEL = "Highest domain risk"
TRACE_DOMAIN_CALC = "Uses the highest offline domain risk as the score floor."
TRACE_DOMAIN_DEFAULT_EVIDENCE = "Domain risk pattern detected."
TRACE_TEXT_DEFAULT_EVIDENCE = "Detected social engineering pattern."
TRACE_COMBO_LABEL = "Domain plus persuasion combo"
TRACE_COMBO_EVIDENCE = "A risky destination appears together with multiple persuasion hooks."
TRACE_COMBO_CALC = "Adds a calibrated synthesis boost for link-and-pressure combinations."
TRACE_BASELINE_LABEL = "Baseline review"
TRACE_BASELINE_EVIDENCE = "No unsafe link or common scam wording was identified."
TRACE_BASELINE_CALC = "No positive risk contribution from the current rule set."

SITUATIONS = ["before_click", "clicked_only", "compromised"]

SAFE_STEPS = {
    "before_click": [
        "DO NOT click any link in the message.",
        "Do not reply to the sender. Scammers often use replies to verify that a phone number or email is active.",
        "Verify independently: use the official website or official app by typing the address yourself.",
        "Report and delete: block the sender, mark it as spam, and remove the message.",
    ],
    "clicked_only": [
        "Close the browser tab immediately to stop any active scripts.",
        "Clear cache and cookies for the browser used to open the link.",
        "Run a security scan using a trusted antivirus or antimalware tool.",
        "Check downloads for recent files such as .exe, .dmg, .apk, or .zip, and delete suspicious files without opening them.",
    ],
    "compromised": [
        "Contact your bank immediately using the official phone number on your card or banking app.",
        "Change passwords immediately on the affected service and anywhere the same password was reused.",
        "Enable multi-factor authentication on email, banking, and social accounts.",
        "Monitor accounts and card transactions for unexpected activity.",
    ],
}
GENERIC_STEPS = [
    "Be cautious and avoid interacting with suspicious links or unknown senders.",
    "Report unsolicited requests for personal or financial information to official portals.",
]
DEFAULT_FIRST_MOVE = "Use official channels before interacting with the sender or link."

QUESTIONS = {
    "before_click": [
        "Did the message arrive from a sender you already trust?",
        "Do you have a separate official app or portal to verify the request?",
    ],
    "clicked_only": [
        "Did the page ask for login, payment, or download permission?",
        "Did any file download automatically after you opened the link?",
    ],
    "compromised": [
        "Which account, card, or identity detail did you enter?",
        "Have you reused that password on email, banking, or social accounts?",
    ],
}

# Case packet (header is neutral and a parameter).
PACKET_HEADER = "CASE PACKET"
PACKET_PRIVACY = "Privacy: User identifiers redacted before analysis"
PACKET_NO_SIGNALS = "No common scam signature"
PACKET_ACTION = "Flag associated links/senders for abuse review and block malicious distribution."
GUARDRAIL_BLOCKED = "ERROR: Output blocked by privacy guardrails due to potential PII leak."

# Offline analyst note.
NOTE_PROVIDER = "offline_rules"
NOTE_MODEL = "deterministic-security-fallback"
NOTE_EXPLANATION = ("Model analyst enrichment is unavailable, so this explanation is "
                    "generated from deterministic rule evidence.")
NOTE_WHY_RULE = "This rule-based signal contributed to the risk score."
NOTE_WHY_DEFAULT = "This signal contributed to the risk estimate."
NOTE_DOMAIN_SIGNAL = "Domain structure was inspected offline."
NOTE_DOMAIN_WHY = "Suspicious layouts can indicate brand impersonation or phishing infrastructure."
NOTE_TEXT_SIGNAL = "Social engineering language was detected."
NOTE_TEXT_WHY = "Pressure tactics are commonly used to rush unsafe decisions."
NOTE_CONFIDENCE = ("Model fallback used; review the local risk evidence and official "
                   "channels before taking action.")
REASON_OFFLINE = "Offline demo mode is enabled."
REASON_NO_RESPONSE = "No model response is available for this message."
REASON_ROUTING = "Model routing failed. "
OVERLAY_CONFIDENCE = "Model enrichment generated from sanitized browser-demo evidence."
OVERLAY_FAILED = "Browser model call failed. Deterministic fallback explanation attached."
PRIORITIES = ["monitor", "caution", "urgent", "lockdown"]
MODEL_ROUTES = [
    "google/gemma-4-31b-it",
    "google/gemma-4-31b-it:free",
    "google/gemma-4-26b-a4b-it",
    "google/gemma-4-26b-a4b-it:free",
    "google/gemma-3-27b-it",
]

# Screenshot text by marker key (first key contained in the upper-cased payload wins).
OCR_TEXTS = [
    ("FIXTURE_BANK",
     "PayPal Security: Your account is temporarily limited. Confirm your "
     "identity at https://paypal-account-review.net/login within 30 minutes."),
    ("FIXTURE_COURIER",
     "FedEx Delivery: Your parcel is on hold for an unpaid customs fee. "
     "Pay $2.99 at https://fedex-delivery-fee.info to release shipment."),
    ("FIXTURE_LOTTERY",
     "Rewards Support: Congratulations, you won a $50,000 prize. Confirm your "
     "phone, email, and tax ID at https://global-rewards-bonus.com/secure-claim."),
    ("FIXTURE_ROMANCE",
     "Iubire, am nevoie urgent de 300 EUR pentru viza. Te rog trimite banii astazi "
     "si nu spune nimanui."),
    ("FIXTURE_QR",
     "Scan this QR code to keep Microsoft 365 mailbox access active: "
     "https://microsoft365-login-review.com"),
]
OCR_DEFAULT_TEXT = OCR_TEXTS[1][1]
OCR_HINT_WORDS = ["bank", "paypal", "card"]

SAMPLES = [
    ("courier", "SMS", "before_click",
     "DHL Express: your parcel has an unpaid customs fee of $3.49. Pay now at "
     "http://dhl.customs-fee-handling.xyz/portal to avoid return."),
    ("bank", "Email", "before_click",
     "PayPal Security: a new sign-in was blocked. Verify your account within 30 "
     "minutes at https://paypal-security-center.live/login."),
    ("lottery", "Email", "before_click",
     "Rewards Support: your email john.doe@gmail.com was selected for a $50,000 "
     "prize. Confirm your phone +1 202 555 0148 and tax ID 123-45-6789 at "
     "https://global-rewards-bonus.com/secure-claim."),
    ("romance", "Chat", "clicked_only",
     "Hello dear, I am trying to visit you next week but I do not have money for "
     "the visa fee. Please send $300 to my account. I love you so much and cannot wait!"),
]
QR_MESSAGE = ("Scan this QR code to keep Microsoft 365 mailbox access active: "
              "https://microsoft365-login-review.com")

# Investigation trace step names.
STEP_OCR = "Multimodal Vision OCR"
STEP_REDACT = "PII Redaction"
STEP_LINKS = "Link Extraction"
STEP_DOMAINS = "Domain Inspection"
STEP_SIGNALS = "Threat Intelligence Check"
STEP_SCORE = "Risk Synthesis"
STEP_PLAN = "Safety Planner"
STEP_NOTE = "Model Analyst"
STEP_PACKET = "Incident Report Generator"
STEP_GUARD = "Safety Review Guardrail"

# Investigation trace step details.
DETAIL_OCR = "Screenshot transcribed successfully: "
DETAIL_REDACT = "Anonymization completed. Sensitive data replaced with secure placeholders."
DETAIL_LINKS = "Extracted "
DETAIL_NO_LINKS = "No links detected in the message text."
DETAIL_HIGH_DOMAINS = "Threat layout check finished. HIGH-RISK domain pattern found: "
DETAIL_DOMAINS = "Domain pattern checks completed. No immediate high-risk spoofing layout detected."
DETAIL_SIGNALS = "Identified "
DETAIL_NO_SIGNALS = "Text analysis completed. No typical social engineering keywords found."
DETAIL_SCORE = "Threat synthesis finished. Verdict: "
DETAIL_PLAN = "Custom safety steps generated successfully ("
DETAIL_NOTE_OFFLINE = "Model enrichment unavailable. Deterministic explanation attached."
DETAIL_NOTE = "Model enrichment completed via "
DETAIL_PACKET = "Authority report draft compiled."
DETAIL_GUARD_FAILED = "Guardrail check FAILED: Raw PII detected in output. Halting."
DETAIL_GUARD = "Guardrail check PASSED. Report is safe to present to the user."

# Lite triage.
LITE_DEFAULT_TEXT = ("Suspicious message asks the recipient to verify account access "
                     "through an unknown link.")
LITE_FIXTURE_TEXTS = [
    ("BANK", "PayPal Security: Your account is temporarily limited. Confirm your identity "
             "at https://paypal-account-review.net/login within 30 minutes."),
    ("LOTTERY", "Rewards Support: Congratulations, you won a $50,000 prize. Submit your "
                "phone number and tax ID at https://global-rewards-bonus.com/secure-claim."),
    ("QR", "Microsoft 365: Scan this QR code to keep mailbox access active. Confirm "
           "password at https://microsoft365-login-review.com."),
]
LITE_EMAIL_PATTERN = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
LITE_PHONE_PATTERN = r"\+?\d[\d\s().-]{7,}\d"
LITE_ID_PATTERN = r"\b\d{3}-\d{2}-\d{4}\b"
LITE_ID_MASK = "[REDACTED_ID]"
LITE_URL_PATTERN = r"(?i)https?://[^\s)]+"
LITE_PAYMENT_PATTERN = r"pay|fee|customs|invoice|bank|card|money|\$|payment"
LITE_DATA_PATTERN = r"verify|confirm|login|password|account|identity|ssn|code|credential"
LITE_URGENCY_PATTERN = r"now|urgent|within|minutes|avoid|blocked|limited|expires|immediate"
LITE_RISKY_ENDINGS = [".xyz", ".live", ".net"]
LITE_SAFE_STEPS = {
    "compromised": [
        "Change the affected password from the official website or app.",
        "Enable MFA and revoke suspicious sessions.",
        "Contact the official provider or bank support channel.",
        "Save the message, transaction details, and timestamps for reporting.",
    ],
    "clicked_only": [
        "Close the page and do not enter any information.",
        "Run a quick device/browser security check.",
        "Change passwords only if you typed credentials.",
        "Verify the request through the official app or typed website.",
    ],
}
# any other situation gets the before_click list of SAFE_STEPS
LITE_LINK_LINES = ["Unsafe destination link detected.", "No clickable URL extracted from visible text."]
LITE_BRAND_LINES = ["Appears to impersonate a trusted company/institution.",
                    "Sender identity cannot be verified from the message."]
LITE_ASK_LINES = ["Asks for immediate payment, bank details, or delivery fees.",
                  "Requests account or identity verification.",
                  "Uses persuasion language that needs independent verification."]
LITE_BRAND_DETAIL = ("Claims to represent ", " while routing to an unverified destination.")
LITE_PAYMENT_DETAIL = "Mentions a payment, fee, prize, or transfer pressure."
LITE_DATA_DETAIL = "Pushes the user toward account, identity, or credential confirmation."
LITE_URGENCY_DETAIL = "Uses time pressure or account consequences to rush action."
LITE_TRACE_LABELS = ["Highest domain risk", "Brand impersonation", "Financial pressure", "Data collection prompt"]

SITUATION_LABELS = {
    "before_click": "Prevention (Not Clicked)",
    "clicked_only": "Inspection (Clicked Link)",
    "compromised": "Recovery (Data Shared)",
}
SITUATION_LABEL_DEFAULT = "Standard Analysis"

# Cleaning of step texts for terminal display: '**' and these symbols are removed.
DASHBOARD_SIGNS = ["\u26a0\ufe0f", "\u274c", "\u2611\ufe0f", "\u26a1\ufe0f"]
STEP_SYMBOLS = ["⚠️", "❌", "🔍", "🗑️", "🌐", "🛡️", "💻", "🚨", "💳", "🔑", "🔒", "📈"]

# Tool names and their aliases.
TOOL_ALIASES = {
    "redact_pii": "clean_text_pii",
    "extract_links": "get_links",
    "inspect_domain_pattern": "analyze_domain",
    "detect_social_engineering": "check_social_engineering",
    "score_risk": "assess_risk",
    "generate_safe_steps": "fetch_safe_steps",
    "generate_report_draft": "draft_report",
}
HISTORY_SIZE = 8
PROMPT_CHARS = 3000
PREVIEW_CHARS = 140
OCR_PREVIEW_CHARS = 60

# Lite report note and trace (display texts; product names neutral).
LITE_NOTE_EXPLANATION = ("The live service is unavailable, so this sample is rendered with "
                         "deterministic demo evidence.")
LITE_NOTE_QUESTIONS = ["Did you enter credentials, payment details, or personal information?",
                       "Can you verify the request through the official app or typed website?"]
LITE_NOTE_CONFIDENCE = "Client-side demo fallback; use the full rules for production analysis."
LITE_NOTE_REASON = "API unreachable or not configured for this browser session."
