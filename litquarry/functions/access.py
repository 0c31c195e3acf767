"""What a page asks for before it shows its paper: kinds of pages and of barriers, by fixed terms in their order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Terms of page types.
PAGE_CHALLENGE = ["verify you are human", "verify that you're not a robot", "verify that you are not a robot", "checking your browser", "captcha", "cloudflare", "attention required", "robot check", "security check"]
PAGE_DENIED = ["access denied", "request blocked", "forbidden", "you don't have permission", "you do not have permission"]
PAGE_LOGIN = ["access through your institution", "sign in to access", "log in to access", "purchase article", "purchase pdf", "subscribe to read"]
PAGE_WEAK_LOGIN = ["institutional access", "get access"]
# Terms of barriers.
CAPTCHA = [
    "verify you are human", "verify that you are human", "prove you are human", "human verification required", "are you a robot", "please confirm you are a human", "captcha challenge below", "请完成人机验证",
    "人机验证", "图形验证码", "drag the slider to verify", "slide to verify", "slider verification", "请拖动滑块", "拖动滑块完成验证", "滑块验证",
]
CAPTCHA_WIDGET = ["g-recaptcha", "h-captcha", "cf-turnstile", "geetest_"]  # beginnings of class attributes
CAPTCHA_DOM = ["recaptcha/api2/anchor", "hcaptcha.com/captcha", "turnstile/v0/", "challenges.cloudflare.com/cdn-cgi/challenge-platform", "/turnstile/", "geetest_slider_button", "geetest_panel"]
CAPTCHA_SURFACE = ["captcha", "challenge", "security check", "security verification", "verify you are human", "verify that you are human", "human verification", "人机验证", "安全验证"]
MFA = [
    "enter the verification code", "enter your verification code", "enter the security code", "enter your security code", "enter the one-time password", "enter your one-time password", "enter the one time password",
    "code from your authenticator app", "open your authenticator app", "multi-factor authentication required", "multifactor authentication required", "two-factor authentication required", "2-factor authentication required",
    "请输入短信验证码", "请输入手机验证码", "请输入动态验证码", "短信验证码", "手机验证码", "动态验证码", "二次验证", "approve sign in request", "approve the sign-in request", "approve the sign in request",
    "check your authenticator app", "we sent a notification to your mobile device", "批准登录请求", "请批准登录请求", "请在身份验证器应用中批准", "请在 authenticator 中批准",
]
BOT = [
    "checking your browser", "checking if the site connection is secure", "performing security verification", "security check", "enable javascript and cookies to continue", "please wait while we verify", "browser verification",
    "正在进行安全验证", "请稍候，我们正在验证", "正在验证您的浏览器",
]
BOT_URL = ["__cf_chl_", "/cdn-cgi/challenge-platform/"]
BOT_TITLES = ["just a moment", "just a moment..."]
DENIED = ["access denied", "request blocked", "request has been blocked", "you have been blocked", "403 forbidden", "unusual traffic detected", "unusual request pattern", "拒绝访问", "请求已被阻止"]
SSO = [
    "single sign-on", "single sign on", "institutional sign in", "institutional login", "sign in through your institution", "access through your institution", "access through your organization", "access through your organisation",
    "choose your institution", "select your institution", "find your institution", "shibboleth", "openathens", "统一身份认证", "机构登录", "机构认证", "选择机构", "选择您的机构", "查找您的机构", "选择组织", "选择您的组织", "查找您的组织",
    "组织登录", "组织认证", "使用中国科技云通行证登录", "中国科技云通行证账号登录", "carsi",
]
SSO_TITLES = [
    "institutional sign in", "institutional login", "choose your institution", "select your institution", "find your institution", "access through your organization", "access through your organisation", "选择机构", "选择您的机构",
    "查找您的机构", "选择组织", "选择您的组织", "查找您的组织", "组织登录", "组织认证", "single sign-on", "single sign on", "统一身份认证", "机构登录", "机构认证", "中国科技云通行证登录",
]
AUTH = ["sign in to access", "log in to access", "login to access", "sign in to continue", "log in to continue", "login to continue", "authentication required", "please sign in", "please log in", "请登录后访问", "请先登录", "登录后访问", "您正在登录"]
AUTH_TITLES = ["sign in", "log in", "login", "登录", "认证"]
AUTH_METHODS = ["scegli il metodo di autenticazione", "autenticazione esterna", "autenticazione iris", "choose an authentication method", "select authentication method", "选择认证方式"]
LOGIN_URL = ["/login", "/signin", "/sign-in", "/sso", "/shibboleth", "/openathens", "/oauth", "/authorize", "/saml", "/cas/"]
ENTITLEMENT = [
    "your institution does not have access", "your organization does not have access", "subscription required to access", "purchase this article", "rent or buy", "buy this article", "sign in or purchase",
    "you do not have access to this pdf", "您的机构没有访问权限", "您的机构无权访问", "当前机构没有访问权限", "暂无访问权限",
]
# How much longer than its term a title or a visible text may be to be nothing else, and how long a text is that has something to read.
TITLE_ROOM, TEXT_ROOM, READABLE = 24, 80, 50


def names_any(text: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(t) for t in terms])


def nothing_but(text: Column, terms: list[str], room: int) -> Column:
    return reduce(lambda a, b: a | b, [text.startswith(t) & (F.length(text) <= len(t) + room) for t in terms])


def page_type(text: Column, scholarly: Column) -> Column:
    """Kind of a page from its title and visible text in lower case, and whether its metadata is that of a paper."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(names_any(t, PAGE_CHALLENGE), "CHALLENGE").when(names_any(t, PAGE_DENIED), "ACCESS_DENIED").when(names_any(t, PAGE_LOGIN), "LOGIN")
        .when(F.coalesce(scholarly, F.lit(False)), "ARTICLE").when(names_any(t, PAGE_WEAK_LOGIN), "LOGIN").when(F.trim(t) != "", "GENERIC").otherwise("UNKNOWN")
    )


def access_challenge(title: Column, url: Column, visible: Column, html: Column) -> Column:
    """The barrier a page raises, the strongest first; NONE where it raises none. All inputs are in lower case with single spaces; null counts as empty."""
    title, url, visible, html = (F.coalesce(c, F.lit("")) for c in (title, url, visible, html))
    text, head = F.concat_ws(" ", title, url, visible), F.concat_ws(" ", title, url)
    widget = reduce(lambda a, b: a | b, [html.contains(f"class={q}{w}") for w in CAPTCHA_WIDGET for q in "\"'"])
    captcha = names_any(text, CAPTCHA) | names_any(html, CAPTCHA_DOM) | (widget & names_any(head, CAPTCHA_SURFACE))
    bot = names_any(text, BOT)
    readable = title.endswith(".pdf") | ((title != "") & (F.length(visible) > READABLE) & ~bot)
    sso, login, auth, paywall = names_any(text, SSO), names_any(url, LOGIN_URL), names_any(text, AUTH), names_any(text, ENTITLEMENT)
    several = reduce(lambda a, b: a + b, [text.contains(t).cast("int") for t in SSO]) >= 2
    surface = login | paywall | auth | nothing_but(title, SSO_TITLES, TITLE_ROOM) | nothing_but(visible, SSO, TEXT_ROOM) | several
    return (
        F.when(captcha, "CAPTCHA").when(names_any(text, MFA), "MFA").when(bot | (names_any(url, BOT_URL) & ~readable) | title.isin(BOT_TITLES), "BOT_CHALLENGE").when(names_any(text, DENIED), "ACCESS_DENIED")
        .when(sso & surface, "SSO").when(auth | (login & (names_any(title, AUTH_TITLES) | names_any(text, AUTH_METHODS))), "AUTHENTICATION").when(paywall, "ENTITLEMENT").otherwise("NONE")
    )
