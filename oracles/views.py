"""The canonical tables and request tables in SQL (rules: FIXTURES.md, section 2)."""

from __future__ import annotations

import re

AS_OF = "DATE '1999-01-01'"

VIEWS: dict[str, str] = {
    "ServiceProviders": """
        SELECT CAST(s_suppkey AS BIGINT) AS ProviderID, s_name AS ProviderName,
               CASE WHEN s_nationkey % 5 = 0 THEN 'Utility' ELSE 'Mobile' END AS Category, true AS IsActive
        FROM supplier""",
    "Products": """
        SELECT p_partkey AS ProductID, p_partkey % (SELECT count(*) FROM supplier) AS ProviderID,
               concat('SKU-', CAST(p_partkey AS STRING)) AS SKU, p_name AS Description,
               CAST(p_retailprice AS DECIMAL(18,2)) AS FaceValue, p_partkey % 10 <> 9 AS IsActive
        FROM part""",
    "Users": """
        SELECT c_custkey AS UserID, c_name AS FullName,
               CASE c_custkey % 50
                    WHEN 40 THEN concat('271', lpad(CAST(c_custkey AS STRING), 6, '0'))
                    WHEN 45 THEN concat('2711', lpad(CAST(c_custkey AS STRING), 9, '0'))
                    WHEN 49 THEN concat('27AB', lpad(CAST(c_custkey AS STRING), 7, '0'))
                    ELSE concat('2771', lpad(CAST(c_custkey AS STRING), 7, '0')) END AS MSISDN,
               concat('user', CAST(c_custkey AS STRING), '@example.org') AS Email,
               CASE WHEN c_custkey % 100 = 1 THEN 'Admin'
                    WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN 'Merchant'
                    ELSE 'User' END AS Role,
               CASE c_mktsegment WHEN 'MACHINERY' THEN 'Premium' WHEN 'AUTOMOBILE' THEN 'Enterprise'
                    ELSE 'Standard' END AS AccountTier,
               CASE WHEN c_custkey % 50 IN (5, 18, 33) THEN 'Disabled' WHEN c_custkey % 50 = 12 THEN 'Suspended'
                    ELSE 'Active' END AS ServiceStatus,
               DATE '1995-01-01' AS CreatedAt
        FROM customer""",
    "Wallets": """
        SELECT c_custkey AS WalletID, c_custkey AS UserID, CAST(c_acctbal AS DECIMAL(18,2)) AS Balance,
               'ZAR' AS CurrencyCode, DATE '1998-12-31' AS LastUpdated
        FROM customer WHERE c_custkey % 100 <> 7""",
    "Merchants": """
        SELECT c_custkey AS MerchantID, c_custkey AS UserID,
               concat('Business_', CAST(c_custkey AS STRING)) AS BusinessName,
               concat('REG-2024-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')) AS RegistrationNumber,
               CASE c_custkey % 22 WHEN 13 THEN 'Suspended' WHEN 14 THEN 'Deactivated' WHEN 9 THEN 'Pending'
                    ELSE 'Active' END AS MerchantStatus,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'Standard' WHEN 'MACHINERY' THEN 'Premium'
                    ELSE 'Enterprise' END AS MerchantTier,
               DATE '1995-01-01' AS CreatedAt, DATE '1995-01-01' AS UpdatedAt
        FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE')""",
    "Commissions": """
        SELECT CASE WHEN k = 4 THEN 1000000000 + p_partkey ELSE p_partkey * 3 + k END AS CommissionID,
               p_partkey AS ProductID, tier AS MerchantTier,
               CAST(CASE WHEN k = 4 THEN base ELSE base + (p_size % 6) * 0.5 END AS DECIMAL(5,2))
                   AS CommissionPercentage,
               DATE '1995-01-01' AS EffectiveDate, true AS IsActive
        FROM part, (VALUES (1, 'Standard', 3.0), (2, 'Premium', 5.5), (3, 'Enterprise', 8.0),
                           (4, 'Standard', 6.75)) AS t(k, tier, base)
        WHERE k < 4 OR p_partkey % 100 = 2""",
    "TransactionLedger": """
        SELECT o_orderkey AS EntryID, o_custkey AS WalletID, c.ProductID,
               CAST(o_totalprice AS DECIMAL(18,2)) AS Amount,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) * c.CommissionPercentage * 0.01 AS DECIMAL(18,4))
                   AS CommissionAmount,
               CASE WHEN o_orderkey > 0 AND o_orderkey % 169 = 0
                    THEN concat('TXN-', CAST(o_orderkey - 13 AS STRING))
                    WHEN o_orderkey > 0 AND o_orderkey % 500 = 0
                    THEN concat('TXN-', CAST(o_orderkey - 1 AS STRING))
                    ELSE concat('TXN-', CAST(o_orderkey AS STRING)) END AS ExternalReference,
               CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'P' THEN 'Pending' ELSE 'Failed' END
                   AS ProcessingStatus,
               o_orderdate AS CreatedTimestamp
        FROM orders JOIN Commissions c
          ON c.ProductID = o_orderkey % (SELECT count(*) FROM part)
         AND c.MerchantTier = 'Standard' AND c.CommissionID < 1000000000""",
    "DigitalVouchers": """
        SELECT l_orderkey AS VoucherID,
               CASE WHEN l_orderkey % 499 = 0 THEN -l_orderkey - 1 ELSE l_orderkey END AS EntryID,
               CAST(l_orderkey * 7919 % 1000000007 AS STRING) AS PinData,
               min(l_shipdate) + INTERVAL '1' YEAR AS ExpiryDate
        FROM lineitem WHERE l_orderkey % 13 <> 0 GROUP BY l_orderkey""",
    "Settlements": """
        SELECT m.MerchantID * 1000000 + year(tl.CreatedTimestamp) * 100 + month(tl.CreatedTimestamp) AS SettlementID,
               m.MerchantID, CAST(date_trunc('month', tl.CreatedTimestamp) AS DATE) AS PeriodStart,
               CAST(date_trunc('month', tl.CreatedTimestamp) + INTERVAL '1' MONTH - INTERVAL '1' DAY AS DATE)
                   AS PeriodEnd,
               sum(tl.Amount) AS GrossAmount, sum(tl.CommissionAmount) AS CommissionAmount,
               sum(tl.Amount) - sum(tl.CommissionAmount) - CASE WHEN m.MerchantID % 11 = 0 THEN 125 ELSE 0 END
                   AS NetAmount,
               'Processed' AS SettlementStatus,
               CAST(date_trunc('month', tl.CreatedTimestamp) + INTERVAL '1' MONTH AS DATE) AS CreatedAt
        FROM TransactionLedger tl JOIN Wallets w ON w.WalletID = tl.WalletID JOIN Merchants m ON m.UserID = w.UserID
        WHERE tl.ProcessingStatus = 'Completed'
        GROUP BY m.MerchantID, year(tl.CreatedTimestamp), month(tl.CreatedTimestamp),
                 date_trunc('month', tl.CreatedTimestamp)""",
    "AuditLog": """
        SELECT event_id AS LogID, CASE WHEN event_id % 50 = 0 THEN -1 ELSE user_id END AS UserID,
               upper(event_type) AS Action, 'Events' AS TableAffected, CAST(event_id AS STRING) AS RecordID,
               CAST(NULL AS STRING) AS OldValue, event_type AS NewValue, ts AS "Timestamp"
        FROM events""",
    "TopupRequests": """
        SELECT event_id AS RequestID, user_id AS WalletID,
               CASE WHEN event_id % 29 = 0 THEN CAST(0 AS DECIMAL(18,2)) ELSE CAST(value AS DECIMAL(18,2)) END
                   AS Amount,
               ts AS RequestedAt
        FROM events WHERE event_type = 'purchase'""",
    "VoucherRequests": """
        SELECT event_id AS RequestID, CASE WHEN event_id % 41 = 0 THEN -1 ELSE user_id END AS WalletID,
               event_id % (SELECT count(*) FROM part) AS ProductID, event_id % 23 AS Quantity,
               CASE WHEN event_id % 37 = 0 THEN CAST(NULL AS STRING)
                    ELSE concat('REF-', CAST(event_id AS STRING)) END AS Reference,
               ts AS RequestedAt
        FROM events WHERE event_type = 'click'""",
    "StatusRequests": """
        SELECT event_id AS RequestID, user_id AS MerchantID,
               CASE event_id % 3 WHEN 0 THEN 'Active' WHEN 1 THEN 'Suspended' ELSE 'Deactivated' END AS NewStatus,
               ts AS RequestedAt
        FROM events WHERE event_type = 'error'""",
    "RegistrationRequests": """
        SELECT event_id AS RequestID,
               CASE WHEN event_id % 3 = 0 THEN concat('2771', lpad(CAST(user_id AS STRING), 7, '0'))
                    ELSE concat('2782', lpad(CAST(event_id % 1500 AS STRING), 7, '0')) END AS MSISDN,
               CASE WHEN event_id % 31 = 0 THEN '' ELSE concat('Applicant ', CAST(event_id AS STRING)) END AS FullName,
               CASE WHEN event_id % 17 = 0 THEN 'a_morg'
                    ELSE concat('a', CAST(event_id AS STRING), '@example.org') END AS Email,
               event_id % 20 AS PasswordLength,
               CASE event_id % 4 WHEN 0 THEN 'Merchant' WHEN 1 THEN 'Admin' ELSE 'User' END AS Role,
               ts AS RequestedAt
        FROM events WHERE event_type = 'signup'""",
    "MerchantRequests": """
        SELECT event_id AS RequestID, event_id % (SELECT count(*) FROM customer) AS UserID,
               CASE WHEN event_id % 43 <> 0 THEN concat('Shop ', CAST(event_id AS STRING)) END AS BusinessName,
               CASE WHEN event_id % 11 = 0 THEN concat('REG-', CAST(event_id AS STRING))
                    ELSE concat('REG-2025-', lpad(CAST(event_id % 10000 AS STRING), 4, '0')) END
                   AS RegistrationNumber,
               ts AS RequestedAt
        FROM events WHERE event_type = 'view'""",
    "ProductRequests": """
        SELECT event_id AS RequestID,
               CASE WHEN event_id % 4 <> 0 THEN event_id % ((SELECT count(*) FROM part) + 25) END AS ProductID,
               CASE WHEN event_id % 4 = 0 AND event_id % 52 <> 0
                    THEN event_id % (SELECT count(*) FROM supplier) END AS ProviderID,
               CASE WHEN event_id % 28 = 0
                    THEN concat('SKU-', CAST(event_id % (SELECT count(*) FROM part) AS STRING))
                    WHEN event_id % 4 = 0 THEN concat('NEW-', CAST(event_id % 800 AS STRING)) END AS SKU,
               CASE WHEN event_id % 4 = 0 OR event_id % 3 = 0
                    THEN concat('Item ', CAST(event_id AS STRING)) END AS Description,
               CASE WHEN event_id % 5 <> 0 THEN CAST(value AS DECIMAL(18,2)) END AS FaceValue,
               CASE WHEN event_id % 4 <> 0 AND event_id % 7 = 0 THEN false END AS IsActive,
               ts AS RequestedAt
        FROM events WHERE event_type = 'view'""",
    "RuleRequests": """
        SELECT event_id AS RequestID,
               CASE event_id % 5 WHEN 0 THEN 'create' WHEN 1 THEN 'delete' ELSE 'update' END AS Action,
               CASE WHEN event_id % 5 <> 0 THEN event_id * 17 % ((SELECT count(*) FROM part) * 3 + 30) + 1 END
                   AS CommissionID,
               CASE WHEN event_id % 5 = 0 THEN event_id % ((SELECT count(*) FROM part) + 10) END AS ProductID,
               CASE WHEN event_id % 5 = 0 THEN CASE event_id % 3 WHEN 0 THEN 'Standard' WHEN 1 THEN 'Premium'
                    ELSE 'Enterprise' END END AS MerchantTier,
               CASE WHEN event_id % 5 <> 1 AND event_id % 8 <> 0
                    THEN CAST((event_id % 90) * 0.1 AS DECIMAL(5,2)) END AS CommissionPercentage,
               CASE WHEN event_id % 5 > 1 AND event_id % 6 = 0 THEN false END AS IsActive,
               ts AS RequestedAt
        FROM events WHERE event_type = 'view'""",
    "SaleRequests": """
        SELECT event_id AS RequestID,
               CASE WHEN event_id % 19 = 0 THEN 'abc123xyz'
                    ELSE concat('072', lpad(CAST(event_id % 10000000 AS STRING), 7, '0')) END AS Phone,
               CAST(value AS DECIMAL(18,2)) AS Amount,
               CASE WHEN event_id % 23 = 0 THEN '1234' ELSE lpad(CAST(event_id AS STRING), 16, '0') END AS VoucherPin,
               ts AS RequestedAt
        FROM events WHERE event_type = 'purchase'""",
    "SettlementRequests": """
        SELECT event_id AS RequestID, user_id AS MerchantID, start AS PeriodStart,
               CAST(CASE event_id % 4 WHEN 0 THEN start + INTERVAL '3' MONTH - INTERVAL '1' DAY
                    ELSE start + CAST(event_id % 97 AS INTEGER) END AS DATE) AS PeriodEnd
        FROM (SELECT *, CAST(DATE '1995-01-01' + CAST(event_id % 80 AS INTEGER) * INTERVAL '1' MONTH AS DATE)
                        + CASE WHEN event_id % 4 > 1 THEN CAST(event_id % 28 AS INTEGER) ELSE 0 END AS start
              FROM events WHERE event_type IN ('error', 'signup'))""",
    "TimedSettlementRequests": """
        SELECT RequestID, MerchantID, CAST(PeriodStart AS TIMESTAMP) + CAST(RequestID % 24 AS INTEGER) * INTERVAL '1' HOUR AS PeriodStart,
               CAST(PeriodEnd AS TIMESTAMP) + CAST(RequestID % 19 AS INTEGER) * INTERVAL '1' HOUR AS PeriodEnd
        FROM SettlementRequests""",
    # Newest rows by time; ties by EntryID. Each wallet has one owner and at most one profile here.
    "Recent": """
        SELECT tl.*, w.UserID, coalesce(m.MerchantTier, 'Standard') AS EffectiveTier
        FROM TransactionLedger tl JOIN Wallets w ON w.WalletID = tl.WalletID
        LEFT JOIN Merchants m ON m.UserID = w.UserID
        ORDER BY tl.CreatedTimestamp DESC, tl.EntryID LIMIT 1000""",
    "RecentRules": """
        SELECT r.*, c.CommissionPercentage, r.Amount * c.CommissionPercentage * 0.01 AS Expected
        FROM Recent r JOIN Commissions c
          ON c.ProductID = r.ProductID AND c.MerchantTier = r.EffectiveTier AND c.IsActive""",
    "LedgerRules": """
        SELECT tl.*, m.MerchantTier, tl.Amount * c.CommissionPercentage * 0.01 AS Expected
        FROM TransactionLedger tl JOIN Wallets w ON w.WalletID = tl.WalletID
        LEFT JOIN Merchants m ON m.UserID = w.UserID
        JOIN Commissions c ON c.ProductID = tl.ProductID AND c.IsActive
         AND c.MerchantTier = coalesce(m.MerchantTier, 'Standard')""",
    "Ghosts": """
        SELECT tl.* FROM TransactionLedger tl
        WHERE NOT EXISTS (SELECT 1 FROM DigitalVouchers dv WHERE dv.EntryID = tl.EntryID)""",
    "FirstRules": """
        SELECT ProductID, MerchantTier, min(CommissionID) AS CommissionID,
               arg_min(CommissionPercentage, CommissionID) AS CommissionPercentage
        FROM Commissions WHERE IsActive GROUP BY ProductID, MerchantTier""",
    "ValidVoucherRequests": """
        SELECT * FROM VoucherRequests
        WHERE WalletID <> 0 AND ProductID <> 0 AND Reference <> '' AND Quantity BETWEEN 1 AND 20""",
    "VoucherLines": """
        SELECT v.RequestID, CAST(u.unit AS INTEGER) AS Unit,
               upper(concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4),
                               substr(h, 21, 12))) AS EntryID,
               v.WalletID, v.ProductID, p.FaceValue AS Amount,
               CAST(p.FaceValue * coalesce(c.CommissionPercentage, 0) * 0.01 AS DECIMAL(18,4)) AS CommissionAmount,
               concat(v.Reference, '-', CAST(u.unit AS STRING)) AS ExternalReference, v.RequestedAt, w.UserID
        FROM ValidVoucherRequests v
        JOIN Wallets w ON w.WalletID = v.WalletID
        JOIN Products p ON p.ProductID = v.ProductID
        LEFT JOIN FirstRules c ON c.ProductID = v.ProductID AND c.MerchantTier = 'Standard'
        JOIN range(1, 21) AS u(unit) ON u.unit <= v.Quantity,
        LATERAL (SELECT md5(concat('voucher-', CAST(v.RequestID AS STRING), '-', CAST(u.unit AS STRING))) AS h) AS d""",
    "CheckedLines": """
        SELECT l.*, row_number() OVER (PARTITION BY l.WalletID ORDER BY RequestedAt, RequestID, Unit) AS seq
        FROM VoucherLines l JOIN Users us ON us.UserID = l.UserID WHERE us.ServiceStatus = 'Active'""",
    "Walk": """
        SELECT c.WalletID, c.seq, c.RequestID, c.Unit, c.Amount <= w.Balance AS taken,
               CASE WHEN c.Amount <= w.Balance THEN w.Balance - c.Amount ELSE w.Balance END AS rest
        FROM CheckedLines c JOIN Wallets w ON w.WalletID = c.WalletID WHERE c.seq = 1
        UNION ALL
        SELECT c.WalletID, c.seq, c.RequestID, c.Unit, c.Amount <= k.rest,
               CASE WHEN c.Amount <= k.rest THEN k.rest - c.Amount ELSE k.rest END
        FROM Walk k JOIN CheckedLines c ON c.WalletID = k.WalletID AND c.seq = k.seq + 1""",
    "Registrations": """
        SELECT r.*,
               CASE WHEN coalesce(MSISDN, '') = '' OR coalesce(FullName, '') = '' OR coalesce(Email, '') = ''
                         OR PasswordLength = 0 THEN 'missing field'
                    WHEN PasswordLength < 8 THEN 'password too short' END AS problem
        FROM RegistrationRequests r""",
    "RegistrationOutcomes": """
        SELECT r.* EXCLUDE (problem, Role),
               CASE WHEN Role IN ('User', 'Merchant') THEN Role ELSE 'User' END AS Role,
               problem IS NULL AND place = 1 AND NOT taken AS Accepted,
               CASE WHEN problem IS NOT NULL THEN problem
                    WHEN place > 1 OR taken THEN 'msisdn already registered' END AS Reason
        FROM (SELECT x.*, row_number() OVER (PARTITION BY MSISDN, problem IS NULL
                                             ORDER BY RequestedAt, RequestID) AS place,
                     MSISDN IN (SELECT MSISDN FROM Users) AS taken
              FROM Registrations x) r""",
    "MerchantOutcomes": """
        SELECT * EXCLUDE (problem, place),
               problem IS NULL AND place = 1 AS Accepted,
               coalesce(problem, CASE WHEN place > 1 THEN 'profile exists' END) AS Reason
        FROM (SELECT y.*, row_number() OVER (PARTITION BY UserID, problem IS NULL
                                             ORDER BY RequestedAt, RequestID) AS place
              FROM (SELECT r.*, u.Role,
                           CASE WHEN coalesce(BusinessName, '') = '' OR coalesce(RegistrationNumber, '') = ''
                                THEN 'name and number required'
                                WHEN NOT regexp_full_match(RegistrationNumber, 'REG-[0-9]{4}-[0-9]{4}')
                                THEN 'malformed registration number'
                                WHEN u.Role IS NULL OR u.Role NOT IN ('Merchant', 'Admin') THEN 'role not allowed'
                                WHEN r.UserID IN (SELECT UserID FROM Merchants) THEN 'profile exists'
                           END AS problem
                    FROM MerchantRequests r LEFT JOIN Users u ON u.UserID = r.UserID) y)""",
    "ProductOutcomes": """
        SELECT * EXCLUDE (problem, place),
               CASE WHEN problem IS NOT NULL OR (ProductID IS NULL AND place > 1) THEN 'rejected'
                    WHEN ProductID IS NULL THEN 'created' ELSE 'updated' END AS Outcome,
               coalesce(problem, CASE WHEN ProductID IS NULL AND place > 1 THEN 'sku exists' END) AS Reason
        FROM (SELECT y.*, row_number() OVER (PARTITION BY SKU, ProductID IS NULL AND problem IS NULL
                                             ORDER BY RequestedAt, RequestID) AS place
              FROM (SELECT r.*,
                           CASE WHEN ProductID IS NULL THEN
                                CASE WHEN coalesce(ProviderID, 0) = 0 OR coalesce(SKU, '') = ''
                                          OR coalesce(Description, '') = '' OR FaceValue IS NULL THEN 'missing field'
                                     WHEN ProviderID NOT IN (SELECT ProviderID FROM ServiceProviders)
                                     THEN 'provider not found'
                                     WHEN SKU IN (SELECT SKU FROM Products) THEN 'sku exists' END
                                WHEN Description IS NULL AND FaceValue IS NULL AND IsActive IS NULL
                                THEN 'nothing to update'
                                WHEN ProductID NOT IN (SELECT ProductID FROM Products) THEN 'product not found'
                           END AS problem
                    FROM ProductRequests r) y)""",
    "CreatedProducts": """
        SELECT row_number() OVER (ORDER BY RequestedAt, RequestID) + (SELECT max(ProductID) FROM Products) AS ProductID,
               ProviderID, SKU, Description, FaceValue, coalesce(IsActive, true) AS IsActive
        FROM ProductOutcomes WHERE Outcome = 'created'""",
    # Changes and deletions of known rules, one step of the walk each.
    "RuleSteps": """
        SELECT r.*, row_number() OVER (PARTITION BY CommissionID ORDER BY RequestedAt, RequestID) AS seq
        FROM RuleRequests r
        WHERE Action <> 'create' AND CommissionID IN (SELECT CommissionID FROM Commissions)""",
    "RuleWalk": """
        SELECT CommissionID, 0::BIGINT AS seq, NULL::BIGINT AS RequestID, true AS alive, NULL::VARCHAR AS done,
               NULL::DECIMAL(5,2) AS old, CommissionPercentage AS pct FROM Commissions
        UNION ALL
        SELECT s.CommissionID, s.seq, s.RequestID, k.alive AND s.Action <> 'delete',
               CASE WHEN NOT k.alive THEN NULL::VARCHAR WHEN s.Action = 'delete' THEN 'deleted'
                    WHEN s.CommissionPercentage IS NOT NULL OR s.IsActive IS NOT NULL THEN 'updated' END,
               k.pct, CASE WHEN k.alive THEN coalesce(s.CommissionPercentage, k.pct) ELSE k.pct END
        FROM RuleWalk k JOIN RuleSteps s ON s.CommissionID = k.CommissionID AND s.seq = k.seq + 1""",
    "RuleOutcomes": """
        SELECT *, CASE WHEN Reason IS NOT NULL THEN 'rejected' WHEN Action = 'create' THEN 'created'
                       WHEN Action = 'update' THEN 'updated' ELSE 'deleted' END AS Outcome
        FROM (SELECT r.*,
                     CASE WHEN Action = 'create' THEN
                          CASE WHEN coalesce(ProductID, 0) = 0 OR MerchantTier IS NULL
                                    OR CommissionPercentage IS NULL THEN 'missing field'
                               WHEN ProductID NOT IN (SELECT ProductID FROM Products) THEN 'product not found' END
                          WHEN Action = 'update' AND CommissionPercentage IS NULL AND IsActive IS NULL
                          THEN 'nothing to update'
                          WHEN RequestID NOT IN (SELECT RequestID FROM RuleWalk WHERE done IS NOT NULL)
                          THEN 'rule not found'
                     END AS Reason
              FROM RuleRequests r)""",
    "RuleChanges": """
        SELECT CommissionID,
               arg_max(CommissionPercentage, (RequestedAt, RequestID))
                   FILTER (WHERE CommissionPercentage IS NOT NULL) AS pct,
               arg_max(IsActive, (RequestedAt, RequestID)) FILTER (WHERE IsActive IS NOT NULL) AS active
        FROM RuleOutcomes WHERE Outcome = 'updated' GROUP BY CommissionID""",
    "RulesAfter": """
        SELECT c.CommissionID, c.ProductID, c.MerchantTier,
               coalesce(h.pct, c.CommissionPercentage) AS CommissionPercentage, c.EffectiveDate,
               coalesce(h.active, c.IsActive) AS IsActive
        FROM Commissions c LEFT JOIN RuleChanges h ON h.CommissionID = c.CommissionID
        WHERE c.CommissionID NOT IN (SELECT CommissionID FROM RuleOutcomes WHERE Outcome = 'deleted')
        UNION ALL
        SELECT row_number() OVER (ORDER BY RequestedAt, RequestID) + (SELECT max(CommissionID) FROM Commissions),
               ProductID, MerchantTier, CommissionPercentage, DATE '1999-01-01', true
        FROM RuleOutcomes WHERE Outcome = 'created'""",
    "MerchantsAfter": """
        SELECT m.MerchantID, m.UserID, m.BusinessName, m.RegistrationNumber,
               coalesce(s.status, m.MerchantStatus) AS MerchantStatus, m.MerchantTier, m.CreatedAt,
               coalesce(s.at, CAST(m.UpdatedAt AS TIMESTAMP)) AS UpdatedAt
        FROM Merchants m LEFT JOIN
             (SELECT MerchantID, NewStatus AS status, RequestedAt AS at FROM StatusRequests
              QUALIFY row_number() OVER (PARTITION BY MerchantID ORDER BY RequestedAt DESC, RequestID DESC) = 1) s
             ON s.MerchantID = m.MerchantID""",
}


def with_views(sql: str) -> str:
    """Prefix the CTEs the statement needs, in the order of their definition."""
    needed, pending = set(), [sql]
    while pending:
        words = set(re.findall(r"[A-Za-z]+", pending.pop()))
        for name in (words & VIEWS.keys()) - needed:
            needed.add(name)
            pending.append(VIEWS[name])
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in needed)
    return f"WITH RECURSIVE {ctes}\n{sql}"
