"""Words, parameters and limits that results depend on. All are defaults of arguments."""

EXTRACTOR_VERSION = 5

# Query parameters that carry a code, and redirect parameters, followed one level.
COUPON_PARAMS = ["coupon", "couponcode", "coupon_code", "code", "promo", "promocode", "promo_code", "promotion_code", "discount", "discountcode", "discount_code", "voucher", "vouchercode", "offer", "offercode", "cpn"]
REDIRECT_PARAMS = ["url", "u", "r", "redirect", "redirect_url", "dest", "destination", "target", "link", "to"]

# Phrases that announce a code.
TRIGGER_PHRASES = ["use code", "using code", "with code", "apply code", "enter code", "coupon code", "promo code", "promotion code", "discount code", "voucher code", "offer code", "code:"]

# Upper-case words of promotional mail that are no codes.
BLOCKLIST = """
ACCOUNT ANDROID ARRIVALS BESTSELLER BROWSER CANCEL CART CHECKOUT CLICK COLLECTION CONDITIONS CONTACT COPYRIGHT
DELIVERY DISCOUNT DOWNLOAD EMAIL EXCHANGE EXCLUSIVE FACEBOOK FEATURED GOOGLE HELVETICA HERE HURRY INSTAGRAM
INVOICE IPHONE LIMITED LINKEDIN LOGIN LOWEST NEWSLETTER ONLINE ORDER ORDERS PINTEREST POLICY PREFERENCES PRICES
PRIVACY PRODUCTS RECEIPT REGISTER RESERVED RETURNS RIGHTS SETTINGS SHIPPING SHOPNOW SIGNIN SIGNUP SUBSCRIBE SUPPORT
TERMS TODAY TONIGHT TRACKING TRENDING TWITTER UNSUBSCRIBE VIEW WEEKEND WHATSAPP WISHLIST YOUTUBE
""".split()

# Named character references.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "hellip": "…",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "bull": "•", "middot": "·", "copy": "©", "reg": "®", "trade": "™",
    "deg": "°", "pound": "£", "euro": "€", "yen": "¥", "cent": "¢",
}

# Currency symbols.
SYMBOLS = {"INR": "₹", "USD": "$", "EUR": "€", "GBP": "£", "AED": "AED ", "SGD": "S$", "AUD": "A$", "CAD": "C$", "JPY": "¥"}

# Names of images that are page furniture.
FURNITURE = "(?i)(logo|icon|favicon|pixel|spacer|tracking|beacon|divider|separator|bullet|arrow|social|facebook|twitter|instagram|linkedin|youtube|whatsapp|pinterest|appstore|playstore|badge|avatar|signature|footer|header-bg)"

#: A small set of public suffix rules; pass a full list where it matters. ``!`` marks exceptions, ``*.`` any label.
SUFFIX_RULES = ["com", "net", "org", "in", "co.in", "uk", "co.uk", "org.uk", "de", "fr", "es", "io", "co", "us", "au", "com.au", "jp", "co.jp", "ck", "*.ck", "!www.ck", "blogspot.com", "github.io"]
