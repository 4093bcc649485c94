from marquee.functions.semantics import (ci_eq, ci_key, clean_money, email_ok, full_name,
                                         lenient_decimal, phone_ok, reject_reason,
                                         report_price, sale_price, split_pair)

__all__ = ["ci_eq", "ci_key", "clean_money", "email_ok", "full_name", "lenient_decimal",
           "phone_ok", "reject_reason", "report_price", "sale_price", "split_pair"]
