"""The answer of every query over the canonical tables, written independently of the Spark plans.

Money comes out as DOUBLE, as it does from ``__spark_entry__``.
"""

from __future__ import annotations

from oracles.views import AS_OF

LEDGER = "* REPLACE (CAST(Amount AS DOUBLE) AS Amount, CAST(CommissionAmount AS DOUBLE) AS CommissionAmount)"
LEDGER_TL = LEDGER.replace("* REPLACE", "tl.* REPLACE")
SETTLEMENT = (
    "s.* REPLACE (CAST(s.GrossAmount AS DOUBLE) AS GrossAmount, CAST(s.CommissionAmount AS DOUBLE) AS CommissionAmount,"
    " CAST(s.NetAmount AS DOUBLE) AS NetAmount)"
)
RULE = "c.* REPLACE (CAST(c.CommissionPercentage AS DOUBLE) AS CommissionPercentage)"
PRODUCT = "p.* REPLACE (CAST(p.FaceValue AS DOUBLE) AS FaceValue)"
WALLET = "w.* REPLACE (CAST(w.Balance AS DOUBLE) AS Balance)"
OWNERS = "JOIN Wallets w ON w.WalletID = tl.WalletID JOIN Merchants m ON m.UserID = w.UserID"
OFF = "abs(CommissionAmount - Expected) > 0.01"


def money(expression: str, name: str) -> str:
    return f"CAST({expression} AS DOUBLE) AS {name}"


def percent(part: str, whole: str) -> str:
    """100 * part / whole rounded half up to two decimals, in whole numbers."""
    return f"CAST(({part} * 20000 + {whole}) // nullif(2 * {whole}, 0) AS DOUBLE) / 100"


def plain(expression: str) -> str:
    return f"rtrim(rtrim(CAST(CAST({expression} AS DECIMAL(38,6)) AS STRING), '0'), '.')"


def count_if(condition: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {condition}) AS BIGINT)"


GHOST = "FROM Ghosts tl WHERE tl.ProcessingStatus = 'Completed'"
GHOST_JOIN = "FROM (SELECT * FROM Ghosts WHERE ProcessingStatus = 'Completed') tl"
DONE = "FROM (SELECT * FROM TransactionLedger WHERE ProcessingStatus = 'Completed') tl"

RECONCILIATION = {
    "ghost_count": f"SELECT count(*) AS GhostTransactionCount {GHOST}",
    "ghost_total_impact": f"SELECT {money('sum(Amount)', 'TotalGhostAmount')} {GHOST}",
    "ghost_by_wallet": f"""
        SELECT WalletID, count(*) AS GhostCount, {money('sum(Amount)', 'TotalLostAmount')} {GHOST}
        GROUP BY WalletID""",
    "ghost_by_user": f"""
        SELECT u.UserID, u.FullName, count(*) AS GhostCount, {money('sum(tl.Amount)', 'TotalLost')}
        {GHOST_JOIN} JOIN Wallets w ON w.WalletID = tl.WalletID JOIN Users u ON u.UserID = w.UserID
        GROUP BY u.UserID, u.FullName""",
    "ghost_by_product": f"""
        SELECT p.Description, count(*) AS GhostCount, {money('sum(tl.Amount)', 'TotalAmount')}
        {GHOST_JOIN} JOIN Products p ON p.ProductID = tl.ProductID GROUP BY p.Description""",
    "ghost_by_provider": f"""
        SELECT sp.ProviderName, count(*) AS GhostCount, {money('sum(tl.Amount)', 'TotalAmount')}
        {GHOST_JOIN} JOIN Products p ON p.ProductID = tl.ProductID
        JOIN ServiceProviders sp ON sp.ProviderID = p.ProviderID GROUP BY sp.ProviderName""",
    "ghost_by_status": "SELECT ProcessingStatus, count(*) AS GhostCount FROM Ghosts GROUP BY ProcessingStatus",
    "ghost_daily": f"""
        SELECT CAST(CreatedTimestamp AS DATE) AS TransactionDate, count(*) AS GhostCount {GHOST}
        GROUP BY CAST(CreatedTimestamp AS DATE)""",
    "ghost_commission_impact": f"""
        SELECT EntryID, {money('Amount', 'Amount')}, {money('CommissionAmount', 'CommissionAmount')},
               {money('Amount + CommissionAmount', 'TotalImpact')} {GHOST}""",
    "ghost_duplicate_refs": f"""
        SELECT ExternalReference, count(*) AS Occurrences {GHOST} GROUP BY ExternalReference HAVING count(*) > 1""",
    "ghost_low_balance": f"""
        SELECT w.WalletID, {money('w.Balance', 'Balance')}, count(*) AS GhostCount
        {GHOST_JOIN} JOIN Wallets w ON w.WalletID = tl.WalletID WHERE w.Balance < 10 GROUP BY w.WalletID, w.Balance""",
    "ghost_negative_balance": f"""
        SELECT w.WalletID, {money('w.Balance', 'Balance')}, tl.EntryID, {money('tl.Amount', 'Amount')}
        {GHOST_JOIN} JOIN Wallets w ON w.WalletID = tl.WalletID WHERE w.Balance < 0""",
    "ghost_most_recent": f"""
        SELECT EntryID, WalletID, {money('Amount', 'Amount')}, CreatedTimestamp {GHOST}
        ORDER BY CreatedTimestamp DESC, EntryID LIMIT 10""",
    "ghost_oldest": f"""
        SELECT EntryID, WalletID, {money('Amount', 'Amount')}, CreatedTimestamp {GHOST}
        ORDER BY CreatedTimestamp, EntryID LIMIT 10""",
}

COMMISSIONS = {
    "commission_mismatches_recent": f"""
        SELECT r.EntryID, u.FullName, r.EffectiveTier, p.Description AS Product, {money('r.Amount', 'Amount')},
               {money('r.CommissionAmount', 'AppliedCommission')},
               {money('r.CommissionPercentage', 'CommissionPercentage')},
               {money('round(r.Expected, 2)', 'ExpectedCommission')},
               {money('abs(r.CommissionAmount - round(r.Expected, 2))', 'Difference')}
        FROM RecentRules r JOIN Users u ON u.UserID = r.UserID JOIN Products p ON p.ProductID = r.ProductID
        WHERE abs(r.CommissionAmount - round(r.Expected, 2)) > 0.01""",
    "commission_accuracy": f"""
        SELECT t AS TotalTransactions, c AS CorrectCommissions, {percent('c', 't')} AS AccuracyPercentage
        FROM (SELECT count(*) AS t, {count_if('abs(CommissionAmount - Expected) <= 0.01')} AS c FROM RecentRules)""",
    "mismatches_by_tier": f"""
        SELECT EffectiveTier, t AS TotalTransactions, c AS Mismatches, {percent('c', 't')} AS MismatchPercentage
        FROM (SELECT EffectiveTier, count(*) AS t, {count_if(OFF)} AS c FROM RecentRules GROUP BY EffectiveTier)""",
    "mismatches_by_product": f"""
        SELECT p.Description, count(*) AS TotalTransactions, {count_if(OFF)} AS Mismatches
        FROM RecentRules r JOIN Products p ON p.ProductID = r.ProductID GROUP BY p.Description""",
    "mismatches_by_provider": f"""
        SELECT sp.ProviderName, count(*) AS TotalTransactions, {count_if(OFF)} AS Mismatches
        FROM RecentRules r JOIN Products p ON p.ProductID = r.ProductID
        JOIN ServiceProviders sp ON sp.ProviderID = p.ProviderID GROUP BY sp.ProviderName""",
    "expected_vs_actual": f"""
        SELECT r.EntryID, p.Description, r.EffectiveTier, {money('r.Amount', 'Amount')},
               {money('r.CommissionAmount', 'AppliedCommission')}, {money('round(r.Expected, 2)', 'ExpectedCommission')},
               {money('round(abs(r.CommissionAmount - r.Expected), 2)', 'Difference')}
        FROM RecentRules r JOIN Products p ON p.ProductID = r.ProductID
        WHERE {OFF} AND r.EntryID IN
              (SELECT EntryID FROM Recent ORDER BY CreatedTimestamp DESC, EntryID LIMIT 200)""",
    "duplicate_rule_impact": f"""
        SELECT 'Duplicate Commission Rule (Product 2 - Standard)' AS Issue, count(*) AS AffectedTransactions,
               {money('sum(CommissionAmount)', 'TotalCommissionApplied')}
        FROM TransactionLedger WHERE ProductID = 2 AND abs(CommissionAmount - 6.00) < 0.01""",
    "duplicate_rule_impact_as_rate": f"""
        SELECT 'Duplicate Commission Rule (Product 2 - Standard)' AS Issue, count(*) AS AffectedTransactions,
               {money('sum(CommissionAmount)', 'TotalCommissionApplied')}
        FROM TransactionLedger WHERE ProductID = 2 AND abs(CommissionAmount - Amount * 6.00 * 0.01) < 0.01""",
    "wrong_tier_used": f"""
        SELECT r.EntryID, r.EffectiveTier AS ActualTier, c.MerchantTier AS CommissionTierUsed, p.Description,
               {money('r.CommissionAmount', 'CommissionAmount')}
        FROM Recent r JOIN Products p ON p.ProductID = r.ProductID
        JOIN Commissions c ON c.ProductID = r.ProductID AND c.IsActive AND c.MerchantTier <> r.EffectiveTier
        WHERE abs(r.CommissionAmount - r.Amount * c.CommissionPercentage * 0.01) <= 0.01""",
    "commission_error_impact": f"""
        SELECT {money('sum(abs(CommissionAmount - Expected))', 'TotalAbsoluteError')},
               {money('sum(greatest(CommissionAmount - Expected, 0))', 'OverCommission')},
               {money('sum(greatest(Expected - CommissionAmount, 0))', 'UnderCommission')}
        FROM RecentRules WHERE {OFF}""",
    "top_merchants_errors": f"""
        SELECT m.BusinessName, count(*) AS TransactionsWithError,
               {money('sum(abs(CommissionAmount - Expected))', 'TotalErrorAmount')}
        FROM RecentRules r JOIN Merchants m ON m.UserID = r.UserID WHERE {OFF} GROUP BY m.BusinessName""",
    "accuracy_by_month": f"""
        SELECT y AS TransactionYear, mo AS TransactionMonth, t AS TotalTransactions,
               {percent('c', 't')} AS AccuracyPercentage
        FROM (SELECT CAST(year(CreatedTimestamp) AS INTEGER) AS y, CAST(month(CreatedTimestamp) AS INTEGER) AS mo,
                     count(*) AS t, {count_if('abs(CommissionAmount - Expected) <= 0.01')} AS c
              FROM LedgerRules GROUP BY 1, 2)""",
    "pending_with_commission": f"""
        SELECT count(*) AS PendingTransactionsWithCommission,
               {money('sum(CommissionAmount)', 'TotalCommissionInPending')}
        FROM TransactionLedger WHERE ProcessingStatus = 'Pending' AND CommissionAmount > 0""",
    "enterprise_tier_check": f"""
        SELECT t AS EnterpriseTransactions, c AS Mismatches, {percent('c', 't')} AS MismatchPct
        FROM (SELECT count(*) AS t, {count_if(OFF)} AS c FROM LedgerRules WHERE MerchantTier = 'Enterprise')""",
    "premium_tier_check": f"""
        SELECT count(*) AS PremiumTransactions, {count_if(OFF)} AS Mismatches
        FROM LedgerRules WHERE MerchantTier = 'Premium'""",
    "validation_report": f"""
        SELECT t AS TotalTransactions, c AS CorrectCount, {percent('c', 't')} AS AccuracyPercentage,
               {money('round(e, 2)', 'TotalFinancialError')}
        FROM (SELECT count(*) AS t, {count_if('abs(CommissionAmount - Expected) <= 0.01')} AS c,
                     sum(abs(CommissionAmount - Expected)) AS e FROM RecentRules)""",
    "first_active_rule": f"""
        SELECT ProductID, MerchantTier, CommissionID, {money('CommissionPercentage', 'CommissionPercentage')}
        FROM FirstRules""",
}

HYGIENE = {
    "duplicate_references": """
        SELECT ExternalReference, total AS DuplicateCount, part AS Part, (total + 9999) // 10000 AS Parts,
               string_agg(CAST(EntryID AS STRING), ', ' ORDER BY EntryID) AS AffectedEntryIDs,
               FirstOccurrence, LastOccurrence
        FROM (SELECT *, count(*) OVER same AS total, (row_number() OVER (same ORDER BY EntryID) + 9999) // 10000 AS part,
                     min(CreatedTimestamp) OVER same AS FirstOccurrence, max(CreatedTimestamp) OVER same AS LastOccurrence
              FROM TransactionLedger WINDOW same AS (PARTITION BY ExternalReference))
        WHERE total > 1 GROUP BY ALL""",
    "invalid_msisdn": """
        SELECT UserID, FullName, MSISDN, CAST(length(rtrim(MSISDN)) AS INTEGER) AS Length,
               CASE WHEN left(MSISDN, 1) NOT BETWEEN '0' AND '9' THEN 'Contains non-digits'
                    WHEN length(rtrim(MSISDN)) <> 11 THEN 'Wrong length' ELSE 'Other issue' END AS IssueType
        FROM Users WHERE length(rtrim(MSISDN)) <> 11 OR NOT regexp_full_match(MSISDN, '[0-9]{11}')""",
    "duplicate_commission_rules": f"""
        SELECT ProductID, MerchantTier, total AS RuleCount, part AS Part, (total + 9999) // 10000 AS Parts,
               string_agg({plain('CommissionPercentage')}, ', ' ORDER BY CommissionID) AS Percentages,
               string_agg(CAST(CommissionID AS STRING), ', ' ORDER BY CommissionID) AS CommissionIDs
        FROM (SELECT *, count(*) OVER same AS total, (row_number() OVER (same ORDER BY CommissionID) + 9999) // 10000 AS part
              FROM Commissions WHERE IsActive WINDOW same AS (PARTITION BY ProductID, MerchantTier))
        WHERE total > 1 GROUP BY ALL""",
    "low_balances": f"""
        SELECT w.WalletID, u.UserID, u.FullName, u.Role, {money('w.Balance', 'Balance')}, w.LastUpdated,
               CASE WHEN w.Balance < 0 THEN 'Negative Balance' WHEN w.Balance = 0 THEN 'Zero Balance'
                    WHEN w.Balance < 10 THEN 'Critically Low' ELSE 'Normal' END AS BalanceStatus
        FROM Wallets w JOIN Users u ON u.UserID = w.UserID WHERE w.Balance <= 10""",
    "expired_vouchers": f"""
        SELECT dv.VoucherID, dv.EntryID, tl.CreatedTimestamp AS TransactionDate, dv.ExpiryDate,
               CAST(date_diff('day', {AS_OF}, CAST(dv.ExpiryDate AS DATE)) AS INTEGER) AS DaysUntilExpiry,
               p.Description AS Product
        FROM DigitalVouchers dv JOIN TransactionLedger tl ON tl.EntryID = dv.EntryID
        JOIN Products p ON p.ProductID = tl.ProductID WHERE dv.ExpiryDate < {AS_OF}""",
    "inconsistent_merchant_status": """
        SELECT u.UserID, u.FullName, u.ServiceStatus AS UserStatus, m.MerchantStatus, m.BusinessName, m.MerchantTier
        FROM Users u JOIN Merchants m ON m.UserID = u.UserID
        WHERE NOT (u.ServiceStatus = 'Active' AND m.MerchantStatus = 'Active')""",
    "orphaned_transactions": f"""
        SELECT EntryID, WalletID, {money('Amount', 'Amount')}, CreatedTimestamp FROM TransactionLedger
        WHERE WalletID IS NULL OR WalletID NOT IN (SELECT WalletID FROM Wallets)""",
    "float_precision": f"""
        SELECT EntryID, {money('Amount', 'Amount')}, {money('CommissionAmount', 'CommissionAmount')},
               {money('CommissionAmount - round(CommissionAmount, 2)', 'ExtraDecimals')},
               {money('Amount * 0.05', 'Example5Percent')}
        FROM TransactionLedger WHERE abs(CommissionAmount - round(CommissionAmount, 2)) > 0.0001""",
    "missing_fk_vouchers": """
        SELECT VoucherID, EntryID FROM DigitalVouchers dv
        WHERE NOT EXISTS (SELECT 1 FROM TransactionLedger tl WHERE tl.EntryID = dv.EntryID)""",
    "hygiene_dashboard": f"""
        SELECT 'Duplicate External References' AS CheckName, count(*) AS IssueCount
        FROM (SELECT ExternalReference FROM TransactionLedger GROUP BY ExternalReference HAVING count(*) > 1)
        UNION ALL SELECT 'Invalid MSISDN Formats', count(*) FROM Users
        WHERE NOT regexp_full_match(MSISDN, '[0-9]{{11}}')
        UNION ALL SELECT 'Duplicate Commission Rules', count(*)
        FROM (SELECT 1 FROM Commissions WHERE IsActive GROUP BY ProductID, MerchantTier HAVING count(*) > 1)
        UNION ALL SELECT 'Negative Balances', count(*) FROM Wallets WHERE Balance < 0
        UNION ALL SELECT 'Expired Vouchers', count(*) FROM DigitalVouchers WHERE ExpiryDate < {AS_OF}""",
}

REPORTS = {
    "top10_merchants_revenue": f"""
        SELECT m.MerchantID, m.BusinessName, {money('sum(Amount)', 'TotalRevenue')} {DONE} {OWNERS}
        GROUP BY 1, 2 ORDER BY sum(Amount) DESC, 1 LIMIT 10""",
    "top10_merchants_net": f"""
        SELECT m.MerchantID, m.BusinessName, {money('sum(Amount) - sum(CommissionAmount)', 'NetRevenue')} {DONE} {OWNERS}
        GROUP BY 1, 2 ORDER BY sum(Amount) - sum(CommissionAmount) DESC, 1 LIMIT 10""",
    "merchant_volume_ranking": f"""
        SELECT m.MerchantID, m.BusinessName, count(*) AS TransactionCount FROM TransactionLedger tl {OWNERS}
        GROUP BY 1, 2""",
    "revenue_by_tier": f"""
        SELECT m.MerchantTier, {money('sum(Amount)', 'TotalRevenue')} {DONE} {OWNERS} GROUP BY 1""",
    "revenue_by_provider": f"""
        SELECT sp.ProviderName, {money('sum(Amount)', 'TotalRevenue')} {DONE}
        JOIN Products p ON p.ProductID = tl.ProductID JOIN ServiceProviders sp ON sp.ProviderID = p.ProviderID
        GROUP BY 1""",
    "product_revenue": f"""
        SELECT p.SKU, p.Description, {money('sum(Amount)', 'Revenue')} {DONE}
        JOIN Products p ON p.ProductID = tl.ProductID GROUP BY 1, 2""",
    "bottom10_skus_revenue": f"""
        SELECT p.SKU, p.Description, {money('sum(Amount)', 'TotalRevenue')} {DONE}
        JOIN Products p ON p.ProductID = tl.ProductID GROUP BY 1, 2 ORDER BY sum(Amount), 1 LIMIT 10""",
    "bottom10_skus_volume": f"""
        SELECT p.SKU, count(*) AS SalesCount {DONE}
        JOIN Products p ON p.ProductID = tl.ProductID GROUP BY 1 ORDER BY count(*), 1 LIMIT 10""",
    "monthly_revenue": f"""
        SELECT strftime(CreatedTimestamp, '%Y-%m') AS "Month", {money('sum(Amount)', 'TotalRevenue')} {DONE} GROUP BY 1""",
    "status_totals": f"""
        SELECT ProcessingStatus, count(*) AS TotalTransactions, {money('sum(Amount)', 'TotalValue')}
        FROM TransactionLedger GROUP BY ProcessingStatus""",
}

_USER_WALLET = f"""
    SELECT u.UserID, u.MSISDN, u.FullName, u.Email, u.Role, u.AccountTier, u.ServiceStatus, u.CreatedAt, w.WalletID,
           {money('w.Balance', 'Balance')}, w.CurrencyCode
    FROM Users u LEFT JOIN Wallets w ON w.UserID = u.UserID"""
_VOUCHER = f"""
    SELECT v.*, t.WalletID, t.ProductID, {money('t.Amount', 'Amount')}, t.ExternalReference
    FROM DigitalVouchers v JOIN TransactionLedger t ON t.EntryID = v.EntryID"""
_RULES = f"""
    SELECT {RULE}, p.SKU, p.Description AS ProductDescription
    FROM Commissions c JOIN Products p ON p.ProductID = c.ProductID"""
def _settled(requests: str) -> str:
    return f"""
        SELECT r.RequestID AS SettlementID, r.MerchantID, r.PeriodStart, r.PeriodEnd,
               {money('coalesce(a.gross, 0)', 'GrossAmount')}, {money('coalesce(a.commission, 0)', 'CommissionAmount')},
               {money('coalesce(a.gross - a.commission, 0)', 'NetAmount')}, 'Pending' AS SettlementStatus,
               {AS_OF} AS CreatedAt
        FROM {requests} r LEFT JOIN
             (SELECT q.RequestID, sum(tl.Amount) AS gross, sum(tl.CommissionAmount) AS commission
              {DONE} {OWNERS} JOIN {requests} q ON q.MerchantID = m.MerchantID
               AND tl.CreatedTimestamp BETWEEN q.PeriodStart AND q.PeriodEnd
              GROUP BY q.RequestID) a ON a.RequestID = r.RequestID"""


_SETTLEMENTS = f"SELECT {SETTLEMENT}, m.BusinessName FROM Settlements s JOIN Merchants m ON m.MerchantID = s.MerchantID"
_CATALOGUE = f"""
    SELECT {PRODUCT}, sp.ProviderName, sp.Category
    FROM Products p JOIN ServiceProviders sp ON sp.ProviderID = p.ProviderID"""

READ_MODELS = {
    "users_list": "SELECT UserID, MSISDN, FullName, Email, Role, AccountTier, ServiceStatus, CreatedAt FROM Users",
    "user_with_wallet": _USER_WALLET,
    "user_with_wallet_of_users": f"{_USER_WALLET} WHERE u.UserID IN (SELECT UserID FROM Merchants)",
    "merchant_directory": """
        SELECT m.*, u.MSISDN, u.FullName, u.Email, u.ServiceStatus
        FROM Merchants m JOIN Users u ON u.UserID = m.UserID""",
    "merchant_detail": f"""
        SELECT m.*, u.MSISDN, u.FullName, u.Email, u.ServiceStatus, w.WalletID, {money('w.Balance', 'Balance')},
               w.CurrencyCode
        FROM Merchants m JOIN Users u ON u.UserID = m.UserID LEFT JOIN Wallets w ON w.UserID = u.UserID
        WHERE m.MerchantID IN (SELECT MerchantID FROM StatusRequests)""",
    "merchant_transactions": f"SELECT m.MerchantID, {LEDGER_TL} FROM TransactionLedger tl {OWNERS}",
    "merchant_transactions_of_merchants": f"""
        SELECT m.MerchantID, {LEDGER_TL} FROM TransactionLedger tl {OWNERS}
        WHERE m.MerchantID IN (SELECT MerchantID FROM StatusRequests)""",
    "merchant_balance_of_merchants": f"""
        SELECT w.WalletID, {money('w.Balance', 'Balance')}, w.CurrencyCode, w.LastUpdated, m.BusinessName
        FROM Wallets w JOIN Merchants m ON m.UserID = w.UserID
        WHERE m.MerchantID IN (SELECT MerchantID FROM StatusRequests)""",
    "merchant_balance": f"""
        SELECT w.WalletID, {money('w.Balance', 'Balance')}, w.CurrencyCode, w.LastUpdated, m.BusinessName
        FROM Wallets w JOIN Merchants m ON m.UserID = w.UserID""",
    "product_catalogue": _CATALOGUE,
    "product_detail": f"{_CATALOGUE} WHERE p.ProductID IN (SELECT ProductID FROM VoucherRequests)",
    "wallet_detail": f"""
        SELECT {WALLET}, u.FullName, u.MSISDN, u.ServiceStatus FROM Wallets w JOIN Users u ON u.UserID = w.UserID
        WHERE w.WalletID IN (SELECT WalletID FROM TopupRequests)""",
    "wallet_history": f"""
        SELECT {LEDGER_TL}, p.SKU, p.Description AS ProductDescription
        FROM TransactionLedger tl JOIN Products p ON p.ProductID = tl.ProductID""",
    "wallet_history_of_wallets": f"""
        SELECT {LEDGER_TL}, p.SKU, p.Description AS ProductDescription
        FROM TransactionLedger tl JOIN Products p ON p.ProductID = tl.ProductID
        WHERE tl.WalletID IN (SELECT WalletID FROM Wallets WHERE Balance < 0)""",
    "transactions_search": f"SELECT {LEDGER} FROM TransactionLedger WHERE ProcessingStatus = 'Failed'",
    "transactions_search_of_wallets": f"""
        SELECT {LEDGER} FROM TransactionLedger
        WHERE ProcessingStatus = 'Failed' AND WalletID IN (SELECT WalletID FROM Wallets WHERE Balance < 0)""",
    "transaction_detail": f"""
        SELECT {LEDGER} FROM TransactionLedger WHERE EntryID IN (SELECT EntryID FROM DigitalVouchers)""",
    "voucher_list": _VOUCHER,
    "voucher_detail": f"{_VOUCHER} WHERE v.ExpiryDate < {AS_OF}",
    "commission_rules": _RULES,
    "commission_detail": f"{_RULES} WHERE c.CommissionID IN (SELECT CommissionID FROM RuleRequests)",
    "settlement_list": _SETTLEMENTS,
    "settlement_detail": f"{_SETTLEMENTS} WHERE abs(s.NetAmount - (s.GrossAmount - s.CommissionAmount)) > 0.01",
    "global_ledger": f"""
        SELECT {LEDGER_TL}, {money('w.Balance', 'WalletBalance')}, u.FullName, u.Role, p.SKU,
               p.Description AS ProductDescription
        FROM TransactionLedger tl JOIN Wallets w ON w.WalletID = tl.WalletID JOIN Users u ON u.UserID = w.UserID
        JOIN Products p ON p.ProductID = tl.ProductID""",
    "global_ledger_second_page": f"""
        SELECT {LEDGER_TL}, {money('w.Balance', 'WalletBalance')}, u.FullName, u.Role, p.SKU,
               p.Description AS ProductDescription
        FROM TransactionLedger tl JOIN Wallets w ON w.WalletID = tl.WalletID JOIN Users u ON u.UserID = w.UserID
        JOIN Products p ON p.ProductID = tl.ProductID ORDER BY tl.CreatedTimestamp DESC, tl.EntryID LIMIT 500 OFFSET 500""",
    "global_ledger_of_users": f"""
        SELECT {LEDGER_TL}, {money('w.Balance', 'WalletBalance')}, u.FullName, u.Role, p.SKU,
               p.Description AS ProductDescription
        FROM TransactionLedger tl JOIN Wallets w ON w.WalletID = tl.WalletID JOIN Users u ON u.UserID = w.UserID
        JOIN Products p ON p.ProductID = tl.ProductID WHERE u.UserID IN (SELECT UserID FROM Merchants)""",
    "users_financial": _USER_WALLET,
    "merchant_financials": f"""
        SELECT m.*, u.FullName, u.Email, u.ServiceStatus, {money('w.Balance', 'Balance')}, w.CurrencyCode,
               coalesce(a.n, 0) AS TransactionCount, {money('coalesce(a.revenue, 0)', 'TotalRevenue')}
        FROM Merchants m JOIN Users u ON u.UserID = m.UserID LEFT JOIN Wallets w ON w.UserID = u.UserID
        LEFT JOIN (SELECT wt.UserID, count(*) AS n,
                          sum(Amount) FILTER (WHERE ProcessingStatus = 'Completed') AS revenue
                   FROM TransactionLedger tl JOIN Wallets wt ON wt.WalletID = tl.WalletID GROUP BY wt.UserID) a
               ON a.UserID = m.UserID""",
    "settlements_admin": f"""
        SELECT {SETTLEMENT}, m.BusinessName, u.FullName
        FROM Settlements s JOIN Merchants m ON m.MerchantID = s.MerchantID JOIN Users u ON u.UserID = m.UserID""",
    "revenue_report": f"""
        SELECT sp.ProviderName, p.SKU, p.Description, count(*) AS TotalTransactions,
               {money('sum(Amount)', 'TotalRevenue')}, {money('sum(CommissionAmount)', 'TotalCommission')} {DONE}
        JOIN Products p ON p.ProductID = tl.ProductID JOIN ServiceProviders sp ON sp.ProviderID = p.ProviderID
        GROUP BY 1, 2, 3""",
    "top_merchants_report": f"""
        SELECT m.MerchantID, m.BusinessName, m.MerchantTier, count(*) AS TransactionCount,
               {money('sum(Amount)', 'TotalRevenue')}, {money('sum(CommissionAmount)', 'TotalCommission')} {DONE} {OWNERS}
        GROUP BY 1, 2, 3 ORDER BY sum(Amount) DESC, 1 LIMIT 10""",
    "audit_trail": """
        SELECT a.*, u.FullName AS PerformedBy FROM AuditLog a LEFT JOIN Users u ON u.UserID = a.UserID""",
}

DEFECTS = {
    "settlement_math_mismatch": f"""
        SELECT SettlementID, MerchantID, {money('GrossAmount', 'GrossAmount')},
               {money('CommissionAmount', 'CommissionAmount')}, {money('NetAmount', 'NetAmount')},
               {money('GrossAmount - CommissionAmount', 'ExpectedNet')},
               {money('NetAmount - (GrossAmount - CommissionAmount)', 'Difference')}
        FROM Settlements WHERE abs(NetAmount - (GrossAmount - CommissionAmount)) > 0.01""",
    "inactive_users_transacting": f"""
        SELECT u.UserID, u.FullName, u.ServiceStatus, count(*) AS TransactionCount,
               {money('sum(tl.Amount)', 'TotalAmount')}
        FROM TransactionLedger tl JOIN Wallets w ON w.WalletID = tl.WalletID JOIN Users u ON u.UserID = w.UserID
        WHERE u.ServiceStatus <> 'Active' GROUP BY 1, 2, 3""",
    "overdrawn_transactions": f"""
        SELECT EntryID, WalletID, CreatedTimestamp, {money('Amount', 'Amount')}, {money('before', 'BalanceBefore')}
        FROM (SELECT tl.*, w.Balance + sum(Amount) OVER (PARTITION BY tl.WalletID) - coalesce(sum(Amount) OVER
                         (PARTITION BY tl.WalletID ORDER BY CreatedTimestamp, EntryID
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
              {DONE} JOIN Wallets w ON w.WalletID = tl.WalletID)
        WHERE Amount > before""",
    "rapid_duplicates": """
        SELECT EntryID, earlier AS PreviousEntryID, WalletID, ProductID, CreatedTimestamp,
               date_diff('second', before, CreatedTimestamp) AS SecondsApart
        FROM (SELECT *, lag(EntryID) OVER w AS earlier, lag(CreatedTimestamp) OVER w AS before FROM TransactionLedger
              WINDOW w AS (PARTITION BY WalletID, ProductID ORDER BY CreatedTimestamp, EntryID))
        WHERE date_diff('second', before, CreatedTimestamp) <= 365 * 86400""",
    "bad_references": """
        SELECT RequestID, Reference,
               CASE WHEN coalesce(trim(Reference), '') = '' THEN 'Missing' WHEN length(Reference) > 20 THEN 'Too long'
                    ELSE 'Wrong format' END AS Issue
        FROM VoucherRequests
        WHERE Reference IS NULL OR length(Reference) > 20 OR NOT regexp_full_match(Reference, '[A-Z]+-[0-9]+')""",
    # The bits of every double in parts of 26, added as whole numbers, from the heaviest on.
    "float_drift": f"""
        SELECT * FROM (WITH parts AS (
            SELECT WalletID, level, sum(CAST(floor(x / pow(2.0, 26 * level)) AS HUGEINT)
                                        - 67108864 * CAST(floor(x / pow(2.0, 26 * level + 26)) AS HUGEINT)) AS total
            FROM (SELECT WalletID, CAST(CommissionAmount AS DOUBLE) AS x FROM TransactionLedger), range(-4, 3) AS l(level)
            GROUP BY WalletID, level),
        totals AS (
            SELECT WalletID, list_reduce(list(CAST(total AS DOUBLE) * pow(2.0, 26 * level) ORDER BY level DESC),
                                         lambda a, b: a + b) AS t
            FROM parts GROUP BY WalletID)
        SELECT l.WalletID, {money('l.total', 'DecimalTotal')}, t.t AS DoubleTotal,
               abs(t.t - CAST(l.total AS DOUBLE)) AS Drift
        FROM (SELECT WalletID, sum(CommissionAmount) AS total FROM TransactionLedger GROUP BY WalletID) l
        JOIN totals t ON t.WalletID = l.WalletID)""",
    "null_balances": """
        SELECT w.WalletID, w.UserID, u.FullName, u.ServiceStatus, w.LastUpdated
        FROM Wallets w JOIN Users u ON u.UserID = w.UserID WHERE w.Balance IS NULL""",
    "active_vouchers": f"{_VOUCHER} WHERE v.ExpiryDate >= {AS_OF}",
    "duplicate_msisdn": """
        SELECT MSISDN, count(*) AS Holders
        FROM (SELECT MSISDN FROM Users UNION ALL SELECT MSISDN FROM RegistrationRequests)
        GROUP BY MSISDN HAVING count(*) > 1""",
    "validate_requests": """
        SELECT Kind, RequestID, Reasons = '' AS Accepted, Reasons FROM (
            SELECT 'voucher' AS Kind, RequestID, concat_ws('; ',
                   CASE WHEN coalesce(WalletID, 0) = 0 THEN 'walletId required' END,
                   CASE WHEN coalesce(ProductID, 0) = 0 THEN 'productId required' END,
                   CASE WHEN coalesce(Reference, '') = '' THEN 'reference required' END,
                   CASE WHEN Quantity < 1 OR Quantity > 20 THEN 'quantity between 1 and 20' END) AS Reasons
            FROM VoucherRequests
            UNION ALL
            SELECT 'top-up', RequestID, concat_ws('; ',
                   CASE WHEN coalesce(WalletID, 0) = 0 THEN 'walletId required' END,
                   CASE WHEN NOT Amount > 0 THEN 'amount must be positive' END,
                   CASE WHEN Amount < 10 THEN 'minimum top-up is 10' END)
            FROM TopupRequests
            UNION ALL
            SELECT 'sale', RequestID, concat_ws('; ',
                   CASE WHEN NOT regexp_full_match(Phone, '0[1-9][0-9]{8}') THEN 'valid phone number required' END,
                   CASE WHEN Amount < 5 OR Amount > 1000 THEN 'amount between 5 and 1000' END,
                   CASE WHEN NOT regexp_full_match(VoucherPin, '[0-9]{16}') THEN '16-digit voucher pin required' END)
            FROM SaleRequests
            UNION ALL
            SELECT 'registration', RequestID, concat_ws('; ',
                   CASE WHEN NOT regexp_full_match(MSISDN, '[0-9]{11}') THEN 'msisdn of 11 digits required' END,
                   CASE WHEN coalesce(FullName, '') = '' THEN 'fullName required' END,
                   CASE WHEN Email NOT LIKE '%_@_%._%' THEN 'valid email required' END,
                   CASE WHEN PasswordLength < 8 THEN 'password of 8 characters required' END)
            FROM RegistrationRequests)""",
}

_VOUCHER_LINE = f"""
    l.RequestID, l.Unit, l.EntryID, l.WalletID, l.ProductID, {money('l.Amount', 'Amount')},
    {money('l.CommissionAmount', 'CommissionAmount')}, l.ExternalReference, 'Completed' AS ProcessingStatus,
    l.RequestedAt AS CreatedTimestamp,
    CAST(CAST(concat('0x', substr(md5(l.EntryID), 1, 8)) AS BIGINT) AS STRING) AS PinData,
    l.RequestedAt + INTERVAL '1' YEAR AS ExpiryDate"""
_RULE_COLUMNS = ["ProductID", "MerchantTier", "CommissionPercentage", "EffectiveDate", "IsActive"]


def _diff_column(column: str) -> str:
    def text(side: str) -> str:
        value = f"{side}.{column}"
        return plain(value) if column == "CommissionPercentage" else f"CAST({value} AS STRING)"

    return f"""
        SELECT CAST(coalesce(o.CommissionID, n.CommissionID) AS STRING) AS RecordID,
               CASE WHEN o.CommissionID IS NULL THEN 'insert' WHEN n.CommissionID IS NULL THEN 'delete'
                    ELSE 'update' END AS Change,
               '{column}' AS ColumnName, {text('o')} AS OldValue, {text('n')} AS NewValue
        FROM Commissions o FULL JOIN RulesAfter n ON n.CommissionID = o.CommissionID
        WHERE {text('o')} IS DISTINCT FROM {text('n')}"""


JOBS = {
    "issue_vouchers": f"SELECT {_VOUCHER_LINE} FROM VoucherLines l",
    "issue_vouchers_balances": f"""
        SELECT w.WalletID, w.UserID, {money('w.Balance - coalesce(s.spent, 0)', 'Balance')}, w.CurrencyCode,
               coalesce(s.at, CAST(w.LastUpdated AS TIMESTAMP)) AS LastUpdated
        FROM Wallets w LEFT JOIN (SELECT WalletID, sum(Amount) AS spent, max(RequestedAt) AS at
                                  FROM VoucherLines GROUP BY WalletID) s ON s.WalletID = w.WalletID""",
    "issue_vouchers_rejected": """
        SELECT r.*, CASE WHEN coalesce(WalletID, 0) = 0 OR coalesce(ProductID, 0) = 0 OR coalesce(Reference, '') = ''
                         THEN 'missing field'
                         WHEN Quantity NOT BETWEEN 1 AND 20 THEN 'quantity must be 1 to 20'
                         WHEN WalletID NOT IN (SELECT WalletID FROM Wallets) THEN 'wallet not found'
                         WHEN ProductID NOT IN (SELECT ProductID FROM Products) THEN 'product not found' END AS Reason
        FROM VoucherRequests r
        WHERE RequestID NOT IN (SELECT RequestID FROM VoucherLines)""",
    "issue_vouchers_checked": f"""
        SELECT {_VOUCHER_LINE} FROM VoucherLines l
        JOIN (SELECT RequestID, Unit FROM Walk WHERE taken) k ON k.RequestID = l.RequestID AND k.Unit = l.Unit""",
    "calculate_settlements": _settled("SettlementRequests"),
    "calculate_settlements_by_time": _settled("TimedSettlementRequests"),
    "apply_topups": f"""
        SELECT w.WalletID, w.UserID, {money('w.Balance + coalesce(s.added, 0)', 'Balance')}, w.CurrencyCode,
               coalesce(s.at, CAST(w.LastUpdated AS TIMESTAMP)) AS LastUpdated
        FROM Wallets w LEFT JOIN (SELECT WalletID, sum(Amount) AS added, max(RequestedAt) AS at FROM TopupRequests
                                  WHERE Amount > 0 GROUP BY WalletID) s ON s.WalletID = w.WalletID""",
    "apply_topups_audit": f"""
        SELECT RequestID, CAST(1 AS BIGINT) AS UserID, 'TOPUP_WALLET' AS Action, 'Wallets' AS TableAffected,
               CAST(WalletID AS STRING) AS RecordID, {plain('after - Amount')} AS OldValue, {plain('after')} AS NewValue
        FROM (SELECT t.*, w.Balance + sum(Amount) OVER (PARTITION BY t.WalletID ORDER BY RequestedAt, RequestID
                                                        ROWS UNBOUNDED PRECEDING) AS after
              FROM TopupRequests t JOIN Wallets w ON w.WalletID = t.WalletID WHERE Amount > 0)""",
    "apply_topups_rejected": f"""
        SELECT RequestID, WalletID, {money('Amount', 'Amount')}, RequestedAt,
               CASE WHEN Amount > 0 THEN 'wallet not found' ELSE 'nothing to add' END AS Reason
        FROM TopupRequests WHERE NOT Amount > 0 OR WalletID NOT IN (SELECT WalletID FROM Wallets)""",
    "change_merchant_status": "SELECT * FROM MerchantsAfter",
    "change_merchant_status_audit": """
        SELECT RequestID, CAST(1 AS BIGINT) AS UserID,
               CASE NewStatus WHEN 'Active' THEN 'ACTIVATE' WHEN 'Suspended' THEN 'SUSPEND' ELSE 'DEACTIVATE' END AS Action,
               'Merchants' AS TableAffected, CAST(MerchantID AS STRING) AS RecordID, CAST(NULL AS STRING) AS OldValue,
               NewStatus AS NewValue
        FROM StatusRequests WHERE MerchantID IN (SELECT MerchantID FROM Merchants)""",
    "change_merchant_status_rejected": """
        SELECT RequestID, MerchantID, NewStatus, 'merchant not found' AS Reason
        FROM StatusRequests WHERE MerchantID NOT IN (SELECT MerchantID FROM Merchants)""",
    "upsert_products": f"""
        SELECT p.ProductID, p.ProviderID, p.SKU, coalesce(d.d, p.Description) AS Description,
               {money('coalesce(d.f, p.FaceValue)', 'FaceValue')}, coalesce(d.a, p.IsActive) AS IsActive
        FROM Products p LEFT JOIN
             (SELECT ProductID,
                     arg_max(Description, (RequestedAt, RequestID)) FILTER (WHERE Description IS NOT NULL) AS d,
                     arg_max(FaceValue, (RequestedAt, RequestID)) FILTER (WHERE FaceValue IS NOT NULL) AS f,
                     arg_max(IsActive, (RequestedAt, RequestID)) FILTER (WHERE IsActive IS NOT NULL) AS a
              FROM ProductOutcomes WHERE Outcome = 'updated' GROUP BY ProductID) d ON d.ProductID = p.ProductID
        UNION ALL
        SELECT ProductID, ProviderID, SKU, Description, CAST(FaceValue AS DOUBLE), IsActive FROM CreatedProducts""",
    "upsert_products_outcomes": f"SELECT * REPLACE ({money('FaceValue', 'FaceValue')}) FROM ProductOutcomes",
    "upsert_products_audit": """
        SELECT CAST(1 AS BIGINT) AS UserID, 'CREATE_PRODUCT' AS Action, 'Products' AS TableAffected,
               CAST(ProductID AS STRING) AS RecordID, CAST(NULL AS STRING) AS OldValue, Description AS NewValue
        FROM CreatedProducts""",
    "change_commission_rules": f"""
        SELECT * REPLACE ({money('CommissionPercentage', 'CommissionPercentage')}) FROM RulesAfter""",
    "change_commission_rules_outcomes": f"""
        SELECT * REPLACE ({money('CommissionPercentage', 'CommissionPercentage')}) FROM RuleOutcomes""",
    "change_commission_rules_audit": f"""
        SELECT CAST(1 AS BIGINT) AS UserID, 'UPDATE_COMMISSION' AS Action, 'Commissions' AS TableAffected,
               CAST(CommissionID AS STRING) AS RecordID, {plain('old')} AS OldValue, {plain('pct')} AS NewValue
        FROM RuleWalk WHERE done = 'updated'""",
    "adjust_tier_rates": f"""
        SELECT c.* REPLACE (CAST(CommissionPercentage + CASE WHEN MerchantTier = 'Standard' AND IsActive THEN 1.5
                                 ELSE 0 END AS DOUBLE) AS CommissionPercentage)
        FROM Commissions c""",
    "adjust_tier_rates_audit": """
        SELECT count(*) AS RulesUpdated, CAST(1 AS BIGINT) AS UserID, 'BULK_RATE_UPDATE' AS Action,
               'Commissions' AS TableAffected, 'ALL' AS RecordID, CAST(NULL AS STRING) AS OldValue,
               'Tier Standard adjusted by 1.5%' AS NewValue
        FROM Commissions WHERE MerchantTier = 'Standard' AND IsActive""",
    "register_users": """
        SELECT row_number() OVER (ORDER BY RequestedAt, RequestID) + (SELECT max(UserID) FROM Users) AS UserID,
               MSISDN, FullName, Email, Role, 'Standard' AS AccountTier, 'Active' AS ServiceStatus,
               RequestedAt AS CreatedAt
        FROM RegistrationOutcomes WHERE Accepted""",
    "register_users_outcomes": """
        SELECT RequestID, MSISDN, FullName, Email, Role, RequestedAt, Accepted, Reason FROM RegistrationOutcomes""",
    "register_users_wallets": """
        SELECT row_number() OVER (ORDER BY RequestedAt, RequestID) + (SELECT max(WalletID) FROM Wallets) AS WalletID,
               row_number() OVER (ORDER BY RequestedAt, RequestID) + (SELECT max(UserID) FROM Users) AS UserID,
               CAST(0 AS DOUBLE) AS Balance, 'ZAR' AS CurrencyCode, RequestedAt AS LastUpdated
        FROM RegistrationOutcomes WHERE Accepted""",
    "register_merchants": """
        SELECT row_number() OVER (ORDER BY RequestedAt, RequestID) + (SELECT max(MerchantID) FROM Merchants)
                   AS MerchantID,
               UserID, BusinessName, RegistrationNumber, 'Pending' AS MerchantStatus,
               CASE Role WHEN 'Admin' THEN 'Enterprise' ELSE 'Standard' END AS MerchantTier,
               RequestedAt AS CreatedAt, RequestedAt AS UpdatedAt
        FROM MerchantOutcomes WHERE Accepted""",
    "register_merchants_outcomes": "SELECT * FROM MerchantOutcomes",
    "books_after_batches": f"""
        SELECT w.WalletID, {money('w.Balance - coalesce(i.spent, 0) + coalesce(a.added, 0)', 'Balance')},
               coalesce(l.n, 0) + coalesce(i.n, 0) AS Entries,
               {money('coalesce(l.amount, 0) + coalesce(i.spent, 0)', 'Amount')},
               coalesce(l.vouchers, 0) + coalesce(i.n, 0) AS Vouchers, coalesce(a.n, 0) AS Topups
        FROM Wallets w
        LEFT JOIN (SELECT WalletID, count(*) AS n, sum(Amount) AS amount, count(*) FILTER (
                       WHERE EntryID IN (SELECT EntryID FROM DigitalVouchers)) AS vouchers
                   FROM TransactionLedger GROUP BY WalletID) l ON l.WalletID = w.WalletID
        LEFT JOIN (SELECT WalletID, count(*) AS n, sum(Amount) AS spent FROM VoucherLines GROUP BY WalletID) i
               ON i.WalletID = w.WalletID
        LEFT JOIN (SELECT WalletID, count(*) AS n, sum(Amount) AS added FROM TopupRequests WHERE Amount > 0
                   GROUP BY WalletID) a ON a.WalletID = w.WalletID""",
    "ghosts_after_increments": f"""
        SELECT EntryID, WalletID, ProductID, {money('Amount', 'Amount')}, ProcessingStatus, CreatedTimestamp FROM Ghosts""",
    "audit_rows": " UNION ALL ".join(_diff_column(column) for column in _RULE_COLUMNS),
    "vouchers_skip_nth": f"""
        SELECT nr - nr // 13 AS VoucherID, EntryID,
               CAST(CAST(concat('0x', substr(md5(CAST(EntryID AS STRING)), 1, 8)) AS BIGINT) AS STRING) AS PinData,
               CASE WHEN WalletID % 27 = 0 THEN CAST({AS_OF} AS TIMESTAMP) - INTERVAL '3' MONTH
                    ELSE CAST({AS_OF} AS TIMESTAMP) + INTERVAL '1' YEAR END AS ExpiryDate
        FROM (SELECT *, row_number() OVER (ORDER BY CreatedTimestamp, EntryID) AS nr {DONE}) WHERE nr % 13 <> 0""",
}

ANSWERS: dict[str, str] = {
    **RECONCILIATION, **COMMISSIONS, **HYGIENE, **REPORTS, **READ_MODELS, **DEFECTS, **JOBS
}
