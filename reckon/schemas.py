"""The ten canonical tables, their column types and value domains.

Money is DECIMAL: amounts (18,2), commissions (18,4), percentages (5,2). Points in time are
TIMESTAMP_NTZ. Identifiers are BIGINT except ``EntryID``, which callers may also keep as text.
"""

from __future__ import annotations

from pyspark.sql import types as T

AMOUNT = T.DecimalType(18, 2)
COMMISSION = T.DecimalType(18, 4)
PERCENT = T.DecimalType(5, 2)

_ID, _TEXT, _FLAG, _TIME = T.LongType(), T.StringType(), T.BooleanType(), T.TimestampNTZType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


SCHEMAS: dict[str, T.StructType] = {
    "ServiceProviders": _struct(ProviderID=_ID, ProviderName=_TEXT, Category=_TEXT, IsActive=_FLAG),
    "Users": _struct(
        UserID=_ID, MSISDN=_TEXT, FullName=_TEXT, Email=_TEXT, Role=_TEXT, AccountTier=_TEXT,
        ServiceStatus=_TEXT, CreatedAt=_TIME,
    ),
    "Merchants": _struct(
        MerchantID=_ID, UserID=_ID, BusinessName=_TEXT, RegistrationNumber=_TEXT, MerchantStatus=_TEXT,
        MerchantTier=_TEXT, CreatedAt=_TIME, UpdatedAt=_TIME,
    ),
    "Wallets": _struct(WalletID=_ID, UserID=_ID, Balance=AMOUNT, CurrencyCode=_TEXT, LastUpdated=_TIME),
    "Products": _struct(
        ProductID=_ID, ProviderID=_ID, SKU=_TEXT, Description=_TEXT, FaceValue=AMOUNT, IsActive=_FLAG
    ),
    "Commissions": _struct(
        CommissionID=_ID, ProductID=_ID, MerchantTier=_TEXT, CommissionPercentage=PERCENT,
        EffectiveDate=_TIME, IsActive=_FLAG,
    ),
    "TransactionLedger": _struct(
        EntryID=_ID, WalletID=_ID, ProductID=_ID, Amount=AMOUNT, CommissionAmount=COMMISSION,
        ExternalReference=_TEXT, ProcessingStatus=_TEXT, CreatedTimestamp=_TIME,
    ),
    "DigitalVouchers": _struct(VoucherID=_ID, EntryID=_ID, PinData=_TEXT, ExpiryDate=_TIME),
    "Settlements": _struct(
        SettlementID=_ID, MerchantID=_ID, PeriodStart=_TIME, PeriodEnd=_TIME, GrossAmount=AMOUNT,
        CommissionAmount=COMMISSION, NetAmount=COMMISSION, SettlementStatus=_TEXT, CreatedAt=_TIME,
    ),
    "AuditLog": _struct(
        LogID=_ID, UserID=_ID, Action=_TEXT, TableAffected=_TEXT, RecordID=_TEXT, OldValue=_TEXT,
        NewValue=_TEXT, Timestamp=_TIME,
    ),
}

# Value domains.
COMPLETED, PENDING, FAILED = "Completed", "Pending", "Failed"
STANDARD, PREMIUM, ENTERPRISE = "Standard", "Premium", "Enterprise"
ACTIVE, SUSPENDED, DEACTIVATED, DISABLED = "Active", "Suspended", "Deactivated", "Disabled"
