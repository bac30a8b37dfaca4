"""Who is behind an event: identifiers, emails and actor types.

The expressions read the columns of :data:`attestry.schemas.EVENT_COLUMNS`.
Column names ignore case, so ``principalId`` and ``principalid`` are one column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry import fixed_values as V
from attestry.functions.text import blank_to_null, clean, clean_sql, col, contains_any, filled, first_filled


def find_email(c: Column | str, source: Column | str | None = None) -> Column:
    """First email address in the lower-cased text, else null (F11); ``source`` is a column that the text is a part of."""
    found = F.get(F.regexp_extract_all(F.lower(col(c)), F.lit(V.EMAIL), F.lit(0)), F.lit(0))
    return F.when(F.contains(col(c if source is None else source), F.lit("@")), found)


def strip_login_prefix(c: Column | str) -> Column:
    """Remove one leading login prefix."""
    return F.regexp_replace(col(c), "^(" + "|".join(V.LOGIN_PREFIXES) + ")", "")


def login_email(c: Column | str, source: Column | str | None = None) -> Column:
    return find_email(strip_login_prefix(c), c if source is None else source)


def session_name(principal: Column | str) -> Column:
    """Part after the first colon, null without a colon."""
    at = F.instr(col(principal), ":")
    return F.when(at > 0, F.substring(col(principal), at + 1, F.length(col(principal))))


def _email_sql(name: str, text: str) -> str:
    """First email in ``text``, a form of column ``name``; the plain search spares most regular expressions."""
    return f"case when contains({name}, '@') then get(regexp_extract_all({text}, r'{V.EMAIL}', 0), 0) end"


def _identifier(name: str) -> Column:
    s = clean_sql(name)
    return F.expr(
        f"case when coalesce({name} <> '', false) then "
        f"coalesce({_email_sql(name, s)}, substring_index({s}, ':', -1)) end")


def _login_email(name: str) -> Column:
    """Email in a column once its login prefix is gone."""
    bare = f"regexp_replace({clean_sql(name)}, '^({'|'.join(V.LOGIN_PREFIXES)})', '')"
    return F.expr(_email_sql(name, bare))


def derived_identifier() -> Column:
    """First non-empty identity field, reduced to an email or its last segment."""
    mails = [
        F.expr(f"case when {clean_sql(c)} rlike r'^{V.EMAIL}' then {clean_sql(c)} end")
        for c in ("user_email", "email", "userEmail")
    ]
    names = [_identifier(c) for c in ("principalId", "sessionIssuerUserName", "userName")]
    nested = [_identifier(f"userIdentity.{c}") for c in ("userName", "principalId", "arn")]
    return F.coalesce(*mails, *names, *nested)


def raw_identifier(derived: Column | str | None = None) -> Column:
    """Derived identifier with the plain-field fallback (F13); ``derived`` names the column that already holds it."""
    fallback = [F.when(filled(c), clean(c)) for c in ("userName", "principalId", "sessionIssuerUserName")]
    return first_filled("human_id", derived_identifier() if derived is None else col(derived), F.coalesce(*fallback))


def iam_user_name() -> Column:
    """User name in an IAM user ARN, null for any other ARN."""
    arn = col("userIdentityArn")
    at = F.instr(arn, V.IAM_USER_MARK)
    name = F.substring(arn, at + len(V.IAM_USER_MARK), F.length(arn))
    return F.when(F.startswith(arn, F.lit(V.IAM_ARN_PREFIX)) & (at > 0), blank_to_null(name))


def is_object_event() -> Column:
    return F.coalesce(col("eventSource") == V.OBJECT_SOURCE, F.lit(False))


def resolved_email(raw: Column | str = "raw_user_id", owner_email: Column | str = "owner_email") -> Column:
    """Email used for correlation, by a fixed order of places to look."""
    on_object = is_object_event()
    places = [_login_email(c) for c in ("human_id", "auth_display_name")]
    places.append(F.when(on_object, login_email(clean(session_name("principalId")), "principalId")))
    places += [F.when(on_object, login_email(F.lower(col(c)), c)) for c in ("userName", "sessionIssuerUserName")]
    places += [_login_email(f"userIdentity.{c}") for c in ("userName", "principalId", "arn", "type")]
    return F.coalesce(*places, col(owner_email), login_email(F.lower(col(raw)), raw))


def by_actor(aws_service, service_principal, service_account, otherwise) -> Column:
    """One of four values by the actor class an event shows without an email."""
    on_service_host = contains_any("sourceIpAddress", [V.AWS_HOST_MARK]) | contains_any("userAgent", [V.AWS_HOST_MARK])
    named_service = contains_any(session_name("principalId"), V.SESSION_NAME_MARKS) | contains_any(
        "sessionIssuerUserName", V.ISSUER_MARKS
    )
    return (
        F.when(on_service_host, aws_service)
        .when(named_service, service_principal)
        .when(col("userIdentityType") == "IAMUser", service_account)
        .otherwise(otherwise)
    )


def actor_type(email: Column | str | None = None) -> Column:
    """Actor class; without ``email`` nobody is human."""
    rest = by_actor(F.lit(V.AWS_SERVICE), F.lit(V.SERVICE_PRINCIPAL), F.lit(V.SERVICE_ACCOUNT), F.lit(V.UNKNOWN))
    return rest if email is None else F.when(filled(email), V.HUMAN).otherwise(rest)
