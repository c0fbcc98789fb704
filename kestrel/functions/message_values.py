"""Fixed values of message analytics: marker patterns, scripts, brands, providers, prefixes."""

#: Marker -> patterns, matched without case, in the order in which markers are reported.
MARKERS = {
    "authority_impersonation": [
        r"\b(?:CBI|ED|NIA|RBI|TRAI|NCB|customs|cyber\s*(?:crime|cell)|income\s*tax|enforcement\s+directorate)\b",
        r"\b(?:inspector|constable|commissioner|sub[- ]?inspector|DCP|ACP|IPS)\b.{0,40}\b(?:speaking|calling|here|from)\b",
        r"\bthis\s+is\s+(?:officer|inspector|constable|agent)\b",
        r"\b(?:police|crime\s*branch)\b.{0,30}\b(?:department|station|headquarters|calling|speaking)\b",
        r"\bcalling\s+from\s+(?:the\s+)?(?:police|court|ministry|government|telecom\s+department)\b",
    ],
    "fake_fir_or_case": [
        r"\bFIR\b",
        r"\b(?:case|complaint|charge\s*sheet)\s+(?:has\s+been\s+|is\s+)?(?:registered|filed|lodged)\b",
        r"\b(?:arrest|non[- ]?bailable)\s+warrant\b",
        r"\bwarrant\s+(?:has\s+been\s+|will\s+be\s+)?issued\b",
        r"\b(?:money\s+laundering|drug\s+trafficking|hawala|narcotics)\s+(?:case|charges?|investigation)\b",
        r"\byour\s+(?:aadhaar|aadhar|PAN|sim|bank\s+account|parcel|courier)\b.{0,50}\b(?:linked|involved|used|found)\b.{0,40}\b(?:crime|illegal|laundering|fraud|drugs)\b",
        r"\b(?:legal\s+action|court\s+case|prosecution)\s+(?:will\s+be|has\s+been)\s+(?:taken|initiated|started)\b",
    ],
    "urgency_pressure": [
        r"\b(?:immediately|right\s+now|within\s+\d+\s*(?:minutes?|hours?)|urgent(?:ly)?|at\s+once)\b",
        r"\b(?:last|final)\s+(?:warning|notice|chance|reminder)\b",
        r"\b(?:account|card|sim|number|service)s?\s+will\s+be\s+(?:blocked|suspended|deactivated|frozen|disconnected)\b",
        r"\b(?:act|pay|respond|verify|update)\s+(?:now|today|immediately)\b",
        r"\bfailure\s+to\s+(?:comply|pay|respond)\b",
        r"\bdo\s+not\s+(?:delay|ignore)\b",
        r"\bexpires?\s+(?:today|tonight|in\s+\d+)\b",
    ],
    "crypto_or_giftcard_demand": [
        r"\b(?:USDT|bitcoin|BTC|crypto(?:currency)?|tether)\b",
        r"\b(?:gift\s*cards?|google\s+play\s+(?:card|code)|amazon\s+(?:gift\s*)?card|iTunes\s+card)\b",
        r"\b(?:transfer|send|deposit|pay)\b.{0,50}\b(?:verification|security|refundable|clearance|settlement)\s+(?:amount|fee|deposit|money)\b",
        r"\b(?:RTGS|NEFT|IMPS|UPI)\b.{0,40}\b(?:immediately|now|verification|safe\s+custody)\b",
        r"\b(?:safe|government|RBI)\s+(?:custody\s+)?account\b.{0,40}\b(?:transfer|deposit|move)\b",
        r"\bmove\s+(?:all\s+)?(?:your\s+)?(?:funds|money|savings)\b.{0,40}\b(?:safe|secure|temporary|verification)\b",
    ],
    "video_call_isolation": [
        r"\b(?:stay|remain|keep)\s+on\s+(?:the\s+|this\s+)?(?:video\s+)?call\b",
        r"\bdo\s+not\s+(?:disconnect|hang\s+up|cut\s+the\s+call|leave\s+the\s+call)\b",
        r"\b(?:skype|whatsapp|zoom)\s+video\s+call\b.{0,40}\b(?:statement|interrogation|verification|questioning)\b",
        r"\bdo\s+not\s+(?:tell|inform|contact|call)\s+(?:anyone|your\s+family|relatives|friends|your\s+bank)\b",
        r"\b(?:digital|virtual|online)\s+(?:arrest|custody|surveillance)\b",
        r"\byou\s+are\s+under\s+(?:digital\s+|virtual\s+)?(?:arrest|surveillance|investigation)\b.{0,40}\b(?:camera|call|online)\b",
        r"\bkeep\s+(?:your\s+)?camera\s+on\b",
    ],
    "personal_data_request": [
        r"(?<!not\s)(?<!never\s)\b(?:share|send|provide|confirm|verify|update)\b.{0,40}\b(?:OTP|one[- ]?time\s+password|PIN|CVV|passwords?)\b",
        r"\b(?:aadhaar|aadhar|PAN)\s+(?:number|card\s+details|details)\b",
        r"\b(?:bank|account)\s+(?:details|number|credentials)\b.{0,30}\b(?:share|send|provide|confirm|verify)\b",
        r"\b(?:share|send|provide|confirm|verify)\b.{0,30}\b(?:bank|account)\s+(?:details|number|credentials)\b",
        r"\b(?:net\s*banking|internet\s+banking)\s+(?:user\s*id|password|credentials)\b",
        r"\bdebit\s+card\s+(?:number|details)\b",
        r"\bKYC\b.{0,40}\b(?:update|verify|expire|complete|pending)\b",
    ],
    "suspicious_link": [
        r"\b(?:https?://)?(?:bit\.ly|tinyurl\.com|t\.co|goo\.gl|cutt\.ly|rb\.gy|is\.gd|shorturl\.at)/\S+",
        r"\bhttps?://\d{1,3}(?:\.\d{1,3}){3}\b",
        r"\b(?:click|tap|open|visit)\b.{0,30}\bhttps?://\S+",
        r"\bhttps?://[^\s/]*(?:-|\.)(?:kyc|verify|update|reward|refund|claim|prize|lucky)[^\s]*",
        r"\b(?:download|install)\s+(?:the\s+)?(?:anydesk|teamviewer|quick\s*support|screen\s+shar\w+)\b",
        r"\bwww\.[^\s]*(?:kyc|verify|claim|prize|reward|refund)[^\s]*",
    ],
    "spoofed_number": [
        r"\b(?:call|dial|contact)\s+(?:back\s+)?(?:on\s+)?\+?\d{2,3}[- ]?\d{5}[- ]?\d{5}\b.{0,30}\b(?:official|government|helpline)\b",
        r"\bthis\s+(?:number|call)\s+is\s+(?:from|the)\s+(?:official|government|police|bank)\b",
        r"\b(?:landline|official)\s+number\s+of\s+(?:the\s+)?(?:police|CBI|court|department)\b",
        r"\bverify\s+(?:this|our)\s+number\s+on\s+(?:the\s+)?(?:website|portal|truecaller)\b",
    ],
}

#: Cues of scam types, tried in this order.
TYPE_CUES = {
    "lottery": [r"\b(?:lottery|lucky\s+draw|jackpot|prize|winner|won\s+(?:rs|₹|\$|\d))\b", r"\bclaim\s+(?:your\s+)?(?:prize|reward|winnings)\b"],
    "loan": [r"\b(?:instant|pre[- ]?approved|easy)\s+loan\b", r"\bloan\s+(?:approved|sanctioned|offer)\b", r"\bzero\s+(?:interest|documentation)\b"],
    "kyc": [r"\bKYC\b", r"\b(?:sim|account|wallet)\s+(?:will\s+be\s+)?(?:blocked|suspended|deactivated)\b.{0,40}\b(?:verify|update)\b"],
}

#: (script, scam type, [(stage, label, markers, own patterns)]); a script counts from two stages on.
SCRIPTS = [
    (
        "digital_arrest",
        "digital_arrest",
        [
            ("establish_authority", "establishes authority", ["authority_impersonation"], []),
            ("fabricate_case", "fabricates a legal case", ["fake_fir_or_case"], []),
            ("isolate_victim", "isolates the victim", ["video_call_isolation"], []),
            ("coerce_payment", "coerces payment", ["crypto_or_giftcard_demand"], []),
        ],
    ),
    (
        "kyc_fraud",
        "kyc",
        [
            ("threaten_service_loss", "threatens loss of service", ["urgency_pressure"], [r"\bKYC\b.{0,40}\b(?:expired?|pending|update|verify)\b"]),
            ("harvest", "harvests credentials or pushes a link", ["personal_data_request", "suspicious_link"], []),
        ],
    ),
    (
        "advance_fee",
        "lottery",
        [
            (
                "bait",
                "baits with a prize or windfall",
                [],
                [r"\b(?:lottery|lucky\s+draw|jackpot|prize|winner|won\s+(?:rs|₹|\$|\d))\b", r"\b(?:pre[- ]?approved|sanctioned)\s+loan\b"],
            ),
            (
                "collect",
                "demands an advance fee or personal data",
                ["crypto_or_giftcard_demand", "personal_data_request", "suspicious_link"],
                [r"\b(?:processing|registration|file|insurance)\s+(?:fee|charge)\b"],
            ),
        ],
    ),
]

#: Words (a trailing * stands for any end) of which a text with a match of any pattern of a marker, or of a stage's or type's own, holds at
#: least one; a text without them need not be searched. Of several words of a pattern the rarest.
WORDS = {
    "authority_impersonation": (
        "cbi ed nia rbi trai ncb customs cyber* income* enforcement inspector constable commissioner subinspector dcp acp ips officer agent police crime* calling"
    ),
    "fake_fir_or_case": "fir registered filed lodged warrant laundering trafficking hawala narcotics crime* illegal fraud drugs taken initiated started",
    "urgency_pressure": (
        "immediately now within urgent* once warning notice chance reminder blocked suspended deactivated frozen disconnected today failure delay ignore expire*"
    ),
    "crypto_or_giftcard_demand": (
        "usdt bitcoin btc crypto* tether gift* google amazon itunes verification security refundable clearance settlement rtgs neft imps upi account move"
    ),
    "video_call_isolation": "call disconnect hang cut leave skype whatsapp zoom tell inform contact arrest custody surveillance investigation camera",
    "personal_data_request": "otp password* pin cvv aadhaar aadhar pan details number credentials netbanking banking debit kyc",
    "suspicious_link": "bit tinyurl co goo cutt rb gd shorturl http* download install www*",
    "spoofed_number": "official government helpline police bank landline website portal truecaller",
    "threaten_service_loss": "kyc",
    "bait": "lottery lucky jackpot prize winner won loan",
    "collect": "fee charge",
    "lottery": "lottery lucky jackpot prize winner won claim",
    "loan": "loan zero",
    "kyc": "kyc blocked suspended deactivated",
}
#: Letters and digits with which a match of any of a marker's, or a stage's own, patterns begins.
FIRST = {
    "authority_impersonation": "acdeinprst", "fake_fir_or_case": "acdfhlmnpwy", "urgency_pressure": "acdefilnprsuvw", "crypto_or_giftcard_demand": "abcdgimnprstu",
    "video_call_isolation": "dkorsvwyz", "personal_data_request": "abcdiknpsuv", "suspicious_link": "bcdghiorstvw", "spoofed_number": "cdlotv",
    "threaten_service_loss": "k", "bait": "jlpsw", "collect": "fipr",
}

#: Entities: links, payment handles, branch codes, phone numbers.
URL = r"\b((?:https?://)?(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,}(?:/[^\s]*)?)"
HANDLE = r"\b([a-z0-9._-]{2,256}@[a-z]{2,64})\b"
BRANCH = r"\b([A-Z]{4}0[A-Z0-9]{6})\b"
PHONE = r"(?<![0-9])((?:\+?91[-\s]?|0)?[6-9][0-9]{9})(?![0-9])"
PROVIDERS = ["okhdfcbank", "okicici", "oksbi", "okaxis", "ybl", "ibl", "axl", "paytm", "apl", "upi", "phonepe", "gpay", "airtel", "freecharge", "fbl"]
MAIL_ENDS = ["com", "in", "org", "net", "co", "io", "gov", "edu"]
BRANDS = ["paytm", "phonepe", "sbi", "hdfc", "icici", "axis", "rbi", "npci", "kotak", "airtel", "amazon", "flipkart"]
SHORTENERS = ["bit.ly", "tinyurl.com", "t.co", "goo.gl", "cutt.ly", "rb.gy", "is.gd", "shorturl.at", "ow.ly", "buff.ly"]
BANKS = {
    "SBIN": "State Bank of India", "HDFC": "HDFC Bank", "ICIC": "ICICI Bank", "UTIB": "Axis Bank", "PUNB": "Punjab National Bank",
    "KKBK": "Kotak Mahindra Bank", "CNRB": "Canara Bank", "BARB": "Bank of Baroda", "IOBA": "Indian Overseas Bank", "UBIN": "Union Bank of India",
}
#: Scripts other than Latin that ask for translation: Brahmic, Perso-Arabic, Ol Chiki, Meetei Mayek.
OTHER_SCRIPTS = "[ऀ-෿؀-ۿ᱐-᱿ꯀ-꯿]"
